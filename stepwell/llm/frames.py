"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a record batch sent to Python. Texts are long, so both are far below Spark's 10,000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
#: What clears the memos of this worker process when a task ends.
_AT_END: list[Callable[[], None]] = []


def at_task_end(clear: Callable[[], None]) -> Callable[[], None]:
    """Register a function that frees a module's memo; every task of `map_batches` calls all of them when it ends."""
    _AT_END.append(clear)
    return clear


def _number(value: str) -> int:
    return int(value.rstrip("b") or 0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with record batches short enough for long texts.

    Spark reads the limits of a batch when the plan runs, so they are settings of the session: a
    larger value is lowered, a smaller one stays. Python workers live on for later tasks, so a
    task's memos are dropped with it and memory doesn't pile up over the stages of a job.
    """
    conf = df.sparkSession.conf
    for name, most in _LIMITS.items():
        if not 0 < _number(conf.get(name)) <= most:
            conf.set(name, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stepwell.llm import frames

        try:
            yield from fn(batches)
        finally:
            for clear in frames._AT_END:
                clear()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can read.

    Where the session names none, a local session (tests) has one below its warehouse folder,
    and any other raises, since the warehouse folder may be on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stepwell"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that an operator writes to the shared folder on its way, to be dropped when it needs them no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage and survives lost executors."""
        path = shared_dir(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete what was kept under these frames; no later plan may read them."""
        remove(self.spark, *(self.paths.pop(id(f))[1] for f in frames if id(f) in self.paths))

    def drop_all_but(self, *frames: DataFrame) -> None:
        kept = {id(f) for f in frames}
        self.drop(*(f for i, (f, _) in list(self.paths.items()) if i not in kept))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. The result stands on the written table, so it is left in place."""
    return Scratch(df.sparkSession).keep(df, name)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by :func:`shared_dir`."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
