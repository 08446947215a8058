"""The keyed ledger of ordered steps on a stream, its replay in batch, and windows by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Steps of a key (qid): when, which unit, of which document.
STEP = "at long, unit string, doc string"
OUT = "qid string, t long, unit string, added_step long, times long, distinct_units long, distinct_docs long, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ledger(StatefulProcessor):
    """A question's units and documents as its steps come in, whatever the order in which they arrive.

    Steps wait in a list until the watermark has passed them; then a timer takes them in the
    order of time and unit, writes them into the ledgers (maps, so that a step touches the state
    of its own unit and document alone) and emits them. A ledger that isn't touched for ``ttl_ms``
    is forgotten.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", STEP)
        self.units = handle.getMapState("units", "unit string", "added_step long, times long", self.ttl_ms)
        self.docs = handle.getMapState("docs", "doc string", "added_step long", self.ttl_ms)
        self.counts = handle.getValueState("counts", "t long, units long, docs long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            late = at // 1000 <= timerValues.getCurrentWatermarkInMs()
            steps = [(int(a), str(u), str(d)) for a, u, d in zip(at[~late], frame["unit"][~late], frame["doc"][~late])]
            if steps:
                self.waiting.appendList(steps)
            for ms in sorted({s[0] // 1000 for s in steps}):
                self.handle.registerTimer(ms)
            nothing = [None] * int(late.sum())
            yield pd.DataFrame({c.split()[0]: nothing for c in OUT.split(", ")}).assign(qid=str(key[0]), unit=frame["unit"][late].to_numpy(), at=frame["at"][late].to_numpy())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = expiredTimerInfo.getExpiryTimeInMs()
        steps = list(self.waiting.get())
        due = sorted(tuple(s) for s in steps if s[0] // 1000 <= last)
        if not due:
            return
        left = [tuple(s) for s in steps if s[0] // 1000 > last]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        t, units, docs = self.counts.get() if self.counts.exists() else (0, 0, 0)
        out = []
        for at, unit, doc in due:
            if self.units.containsKey((unit,)):
                first, times = self.units.getValue((unit,))
            else:
                first, times, units = t, 0, units + 1
            if not self.docs.containsKey((doc,)):
                docs += 1
            self.units.updateValue((unit,), (first, times + 1))
            self.docs.updateValue((doc,), (t,))
            out.append((str(key[0]), t, unit, first, times + 1, units, docs, pd.Timestamp(at, unit="us")))
            t += 1
        self.counts.update((t, units, docs))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_state(steps: DataFrame, late: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """What every step of a stream (qid, at, unit, doc) makes of its question, as `replay` says it.

    Steps may come in any order within ``late``; a step is emitted once the watermark has passed
    it. One that comes behind the watermark is emitted without t and has no part in the ledger.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = steps.select(F.col("qid").cast("string").alias("qid"), F.col("at").cast("timestamp").alias("at"), F.col("unit").cast("string").alias("unit"), F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("doc"))
    return rows.withWatermark("at", late).groupBy("qid").transformWithStateInPandas(Ledger(ttl_ms), OUT, "Append", "EventTime")


def replay(steps: DataFrame) -> DataFrame:
    """The same of a finished table (qid, at, unit, doc): qid, t, unit, added_step, times, distinct_units, distinct_docs."""
    order = Window.partitionBy("qid").orderBy("at", "unit", "doc")
    of_unit = Window.partitionBy("qid", "unit").orderBy("t")
    numbered = steps.select("qid", "at", "unit", F.coalesce("doc", F.lit("")).alias("doc")).withColumn("t", (F.row_number().over(order) - 1).cast("long"))
    first = lambda *keys: (F.row_number().over(Window.partitionBy("qid", *keys).orderBy("t")) == 1).cast("long")
    marked = numbered.select("*", F.row_number().over(of_unit).cast("long").alias("times"), F.first("t").over(of_unit).alias("added_step"), first("unit").alias("_u"), first("doc").alias("_d"))
    so_far = Window.partitionBy("qid").orderBy("t")
    return marked.select("qid", "t", "unit", "added_step", "times", F.sum("_u").over(so_far).alias("distinct_units"), F.sum("_d").over(so_far).alias("distinct_docs"))


def _summed(events: DataFrame, late: str, window: Column, *keys: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by hour and type; on a stream, rows behind the watermark are dropped."""
    return _summed(events, late, F.window("ts", width), "event_type")


def sliding(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", step: str = "20 minutes") -> DataFrame:
    """As `windowed`, over windows that start every ``step`` and overlap."""
    return _summed(events, late, F.window("ts", width, step), "event_type")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    """Counts and sums by key and session: events that follow one another within ``gap``."""
    return _summed(events, late, F.session_window("ts", gap), key)


def dropped_rows(query) -> int:
    """How many rows a streaming query has dropped behind its watermark so far."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
