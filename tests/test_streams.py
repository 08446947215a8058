"""Streams in several micro-batches against the finished table."""

import datetime as dt
import random

import pytest

from stepwell.streaming import state

START = dt.datetime(2024, 1, 1)


def fed(spark, tmp_path, batches, schema, make, name):
    """Each batch of rows as a file of its own, read one at a time; the result rows and the query."""
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{i:02}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{src}/*")
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect(), q


@pytest.mark.parametrize("seed", [1])
def test_shuffled_batches_equal_the_replay(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), START + dt.timedelta(seconds=rng.randrange(3000), microseconds=rng.randrange(3) * 400), f"u{rng.randrange(6)}", rng.choice(["d1", "d2", None])) for _ in range(120)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    late = rows.pop()
    rng.shuffle(rows)
    third = len(rows) // 3
    far = [("z", START + dt.timedelta(days=k), "u", "d") for k in (1, 2)]  # they move the watermark past all others
    batches = [rows[:third], rows[third : 2 * third], rows[2 * third :], far[:1], [late], far[1:]]
    schema = "qid string, at timestamp, unit string, doc string"
    got, _ = fed(spark, tmp_path, batches, schema, lambda s: state.stream_state(s, "1 hour"), "ledger")
    fields = ("qid", "t", "unit", "added_step", "times", "distinct_units", "distinct_docs")
    want = state.replay(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r[f] for f in fields) for r in got if r["qid"] != "z" and r["t"] is not None) == sorted(tuple(r[f] for f in fields) for r in want)
    assert [(r["qid"], r["unit"], r["at"]) for r in got if r["t"] is None] == [(late[0], late[2], late[1])]


@pytest.mark.parametrize("kind", ["windowed", "sliding", "sessions"])
def test_windows_drop_late_rows(spark, tmp_path, kind):
    at = lambda m: START + dt.timedelta(minutes=m)
    first = [(at(m), 1, "view", float(m)) for m in (0, 5, 40, 95, 100)]
    second = [(at(m), 1, "view", float(m)) for m in (300, 305, 90)]  # 90 is in time: the watermark is at 90 still
    third = [(at(10), 1, "view", 1000.0), (at(320), 2, "view", 1.0)]  # the first is late
    last = [(at(9000), 3, "view", 0.0)]
    schema = "ts timestamp, user_id long, event_type string, value double"
    make = getattr(state, kind)
    got, q = fed(spark, tmp_path, [first, second, third, last], schema, make, f"late_{kind}")
    kept = [r for r in first + second + third if r[3] != 1000.0]
    key = "user_id" if kind == "sessions" else "event_type"
    fields = lambda rows: sorted((r["window"]["start"], r["window"]["end"], r[key], r["n"], r["value"]) for r in rows if r["window"]["start"] < at(8000))
    assert fields(got) == fields(make(spark.createDataFrame(kept, schema)).collect())
    assert state.dropped_rows(q) >= 1
