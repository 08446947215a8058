"""The rebuilt front end against a plain version; sources and gates that no statement covers."""

import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stepwell.operators import frontend, gates, teacher
from stepwell.sources import cache
from stepwell.sources import json as sources

from .test_operators import one

TEXTS = ["red fox runs", "the fox sleeps", "a blue bird", "bird and fox", "red red bird", "stone", "old stone fox", "runs fast", "blue stone"]


def plain(question, pool, dense, positive, front_k, top_k, window, lambda_, same_doc, source, count):
    words = {u: re.findall("[a-z0-9]+", x["text"]) for u, x in pool.items()}
    df, n = Counter(w for ws in words.values() for w in set(ws)), len(pool)
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean, avg = sum(idf.values()) / len(idf), sum(map(len, words.values())) / n
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    lexical = {u: round(sum(idf.get(q, 0) * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for q in question.split()), 6) for u, ws in words.items()}
    order = lambda s: sorted(pool, key=lambda u: (-s[u], u))
    bm, dn = order(lexical), order(dense)
    fused = {u: round(1 / (61 + bm.index(u)) + 1 / (61 + dn.index(u)), 6) for u in pool}
    front = order(fused)
    seeds = set(bm[:front_k]) | set(dn[:front_k])
    expanded = {u for u in pool if any(pool[s]["doc"] == pool[u]["doc"] and abs(pool[s]["sent_id"] - pool[u]["sent_id"]) <= window for s in seeds)}
    left, taken = [u for u in front if u in expanded], []
    low, high = min(fused[u] for u in left), max(fused[u] for u in left)
    if len(left) <= top_k:
        left, taken = [], left
    while left and len(taken) < top_k:
        def gain(u):
            alike = [max(len(set(words[u]) & set(words[v])) / len(set(words[u]) | set(words[v])), same_doc * (pool[u]["doc"] == pool[v]["doc"])) for v in taken]
            return lambda_ * ((fused[u] - low) / (high - low) if high - low >= 1e-12 else 0) - (1 - lambda_) * max(alike, default=0)
        best = max(left, key=gain)  # the first among equals
        left.remove(best)
        taken.append(best)
    lists = {"bm25": bm, "dense": dn, "rrf": front}
    mixed = list(dict.fromkeys(u for row in zip(bm, dn, front) for u in row))
    hard = [u for u in (mixed if source == "mixed" else lists[source]) if u in expanded and u != positive][:count]
    final = list(dict.fromkeys([*hard, *taken, positive, *front]))
    final = final[:top_k] if positive in final[:top_k] else [*final[: top_k - 1], positive]
    return final, bm.index(positive) + 1, dn.index(positive) + 1, front.index(positive) + 1, positive in taken, positive not in taken, hard


def test_rebuild_against_a_plain_version(spark):
    rng, pools, dense, positives, questions = np.random.default_rng(3), {}, {}, {}, {}
    for qid in range(12):
        n = int(rng.integers(2, 10))
        pools[qid] = {f"{qid}-{i}": {"doc": i // 4, "sent_id": i % 4, "text": TEXTS[int(rng.integers(9))]} for i in range(n)}
        dense[qid] = {u: float(rng.integers(5)) for u in pools[qid]}
        positives[qid] = f"{qid}-{int(rng.integers(n))}"
        questions[qid] = TEXTS[int(rng.integers(9))]
    pool = spark.createDataFrame([(q, u, x["doc"], x["sent_id"], x["text"]) for q, p in pools.items() for u, x in p.items()], "qid int, unit string, doc int, sent_id int, text string")
    scores = spark.createDataFrame([(q, u, s) for q, d in dense.items() for u, s in d.items()], "qid int, unit string, score double")
    asked, gold = spark.createDataFrame(list(questions.items()), "qid int, text string"), spark.createDataFrame(list(positives.items()), "qid int, unit string")
    for source in ("mixed", "dense"):
        got = {r.qid: tuple(r)[1:] for r in frontend.rebuild(pool, scores, asked, gold, front_k=2, top_k=4, source=source).collect()}
        assert len(got) == 12
        for q in pools:
            assert got[q] == plain(questions[q], pools[q], dense[q], positives[q], 2, 4, 1, 0.7, 0.5, source, 2), q
    assert frontend.rebuild(pool.limit(0), scores.limit(0), asked, gold.limit(0)).count() == 0


def test_reports_digests_configs_and_stamps(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    sources.write_report(df, str(tmp_path / "new" / "report"))
    assert [json.loads(x) for f in (tmp_path / "new" / "report").glob("*.json") for x in f.read_text().splitlines()] == [{"k": 1, "v": "a"}]
    (tmp_path / "f.bin").write_bytes(b"\x00abc")
    r = sources.file_digests(spark, str(tmp_path / "f.bin")).first()
    assert (r.length, r.sha256) == (4, hashlib.sha256(b"\x00abc").hexdigest())
    (tmp_path / "c.json").write_text('{"a": {"b": [1, 2]}, "c": null}')
    config = sources.load_config(str(tmp_path / "c.json"))
    assert config == {"a": {"b": [1, 2]}, "c": None} and sources.flatten_config(config) == {"a.b": [1, 2], "c": None}
    assert cache.stamped(df, "r1", "now").first().build_meta.asDict() == {"run_id": "r1", "built_at": "now"}
    assert one(spark, cache.answer_key(F.lit("2hop__1/ä b:c")))[0] == "2hop__1_b_c"


def test_request_keys_ignore_the_order_of_fields(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2)], "a string, b int")
    keys = [[r[0] for r in df.select(cache.request_key(*f)).collect()] for f in (("a", "b"), ("b", "a"))]
    assert keys[0] == keys[1] == [hashlib.sha256(json.dumps({"a": "x", "b": b}, separators=(",", ":")).encode()).hexdigest() for b in (1, 2)]


def test_gates_over_the_pool(spark):
    texts = lambda *x: F.array(*map(F.lit, x))
    anchors, kind = texts("foxx"), F.lit("year")
    assert tuple(one(spark, gates.answer_ready(texts("a Foxx in 1999"), anchors, kind), gates.answer_ready(texts("a Foxx", "in 1999"), anchors, kind), gates.answer_ready(texts("a", "b", "c", "d", "e", "foxx 1999"), anchors, kind))) == (True, False, False)
    assert tuple(one(spark, gates.bridge_gap(texts("foxx cave", "cave of 1999"), anchors, kind), gates.bridge_gap(texts("foxx cave", "built 1999"), anchors, kind), gates.bridge_gap(texts("foxx cave 1999"), anchors, kind))) == (True, False, False)
    assert one(spark, gates.bridge_gap(texts("foxx cave", "built 1999"), anchors, kind, F.array(F.lit("built"))))[0]
    assert tuple(one(spark, teacher.near_complete(F.array().cast("array<double>")), teacher.legacy_stop(F.array(F.lit(0.8)), F.lit(False), F.array(F.lit(1), F.lit(0))), teacher.legacy_stop(F.array(F.lit(0.8)), F.lit(False), F.array().cast("array<int>")))) == (False, True, False)
