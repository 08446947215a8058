"""Queries over the fixture tables, each with its statement for the oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes for each core below which a table may lie in fewer splits than there are cores.
SMALL_BYTES = 64 << 20


def dealt(frame: DataFrame) -> DataFrame:
    """A small table dealt to all cores before costly work on its texts; a large one has splits enough and stays where it lies."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return frame.repartition(cores) if size < SMALL_BYTES * cores else frame


#: Bytes of lines as they lie for each task that orders them: about half a million rows, so that a task's sorts keep their size.
STEP_BYTES = 8 << 20


def by_order(lines: DataFrame) -> DataFrame:
    """Lines dealt by order to as many tasks as their size asks for, where that is more than a shuffle has anyway."""
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = -(-size // STEP_BYTES)
    return lines.repartition(n, "l_orderkey") if n > int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) else lines


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories: orders are questions, their lines are steps.

    Lines of one number and price go by all that a step shows, so that only equal steps may change places.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    return by_order(table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("qid"),
        (F.row_number().over(order) - 1).cast("long").alias("t"),
        F.col("l_partkey").alias("unit"),
        F.col("l_suppkey").alias("doc"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("A", "bridge", "N", "distinguish", "R", "support")]), F.col("l_returnflag")).alias("role"),
    )


def grouped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, t, unit, doc and discount of the same steps, for what groups them by qid.

    Columns have their names before they are ordered, so that none is shuffled under two names and a question's steps already lie together.
    """
    names = {"qid": "l_orderkey", "line": "l_linenumber", "score": "l_extendedprice", "unit": "l_partkey", "doc": "l_suppkey", "quantity": "l_quantity", "discount": "l_discount", "flag": "l_returnflag"}
    order = Window.partitionBy("qid").orderBy("line", "score", "unit", "doc", "quantity", "discount", "flag")
    lines = by_order(table(spark, sf_dir, "lineitem")).select(*(F.col(c).alias(n) for n, c in names.items()))
    return lines.select("qid", (F.row_number().over(order) - 1).cast("long").alias("t"), "unit", "doc", "discount")


STEPS = """steps AS (
  SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag) - 1 AS t,
         l_partkey AS unit, l_suppkey AS doc, l_extendedprice AS score, l_quantity AS quantity, l_discount AS discount,
         CASE l_returnflag WHEN 'A' THEN 'bridge' WHEN 'N' THEN 'distinguish' ELSE 'support' END AS role
  FROM lineitem)"""
