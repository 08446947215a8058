"""Summaries and resampling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(a: str, b: str) -> Column:
    """Rounded to 6; null for under two points or a constant side."""
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0) & (F.count(F.lit(1)) > 1), F.round(F.corr(a, b), 6))


def percentile(x: str, q: float) -> Column:
    return F.round(F.percentile(x, q), 6)


def ratio_of_sums(num: str, den: str) -> Column:
    return F.round(F.sum(num) / F.greatest(F.sum(den), F.lit(1)), 6)


#: Draws that one digest gives, of so many hex digits each.
DRAWS, DIGITS = 4, 8


def _times(digits: Column) -> Column:
    """How often an id is in a replicate: a Poisson(1) number from digits of its hash, by its distribution function.

    It stands for drawing ids with replacement: every id can be drawn where its row lies, so no
    replicate needs all ids in one place. Values above 7 have a chance below 1e-5 and count as 7.
    The digits of a draw are compared as they are, since hex numbers of one length sort as text.
    """
    bounds, total, p = [], 0.0, math.exp(-1)
    for k in range(7):
        total += p
        bounds.append(f"{math.ceil(total * 16**DIGITS):0{DIGITS}x}")
        p /= k + 1
    return reduce(lambda out, b: out + (digits >= b).cast("int"), bounds, F.lit(0))


def bootstrap(rows: DataFrame, id_: str, num: str, den: str, replicates: int, seed: int) -> DataFrame:
    """observed, ci_low and ci_high (2.5 and 97.5 %) of a ratio of sums over resampled ids.

    Rows grow by a row for each block of replicates within their task and are summed there before the shuffle. They
    are dealt first: they are few and small for what is done with each, so that adaptive
    execution would put them in too few tasks.
    """
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_)
    blocks = dealt.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS) - 1))))
    digest = F.md5(F.concat_ws("::", F.lit(str(seed)), F.col("_b").cast("string"), F.col(id_).cast("string")))
    parts = blocks.select(num, den, "_b", digest.alias("_h")).select(num, den, "_b", *(F.substring("_h", i * DIGITS + 1, DIGITS).alias(f"_{i}") for i in range(DRAWS)))
    drawn = parts.select(num, den, "_b", *(_times(F.col(f"_{i}")).alias(f"_{i}") for i in range(DRAWS)))
    sums = drawn.groupBy("_b").agg(*(F.sum(F.col(c) * F.col(f"_{i}")).alias(f"{n}{i}") for n, c in (("n", num), ("d", den)) for i in range(DRAWS)))
    pairs = F.array(*(F.struct(F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("d")) for i in range(DRAWS)))
    each = sums.select("_b", F.posexplode(pairs).alias("_i", "p")).where(F.col("_b") * DRAWS + F.col("_i") < replicates).select((F.col("p.n") / F.greatest(F.col("p.d"), F.lit(1.0))).alias("v"))
    ends = each.agg(percentile("v", 0.025).alias("ci_low"), percentile("v", 0.975).alias("ci_high"))
    return rows.agg(ratio_of_sums(num, den).alias("observed")).crossJoin(ends)  # one row each


def paired_bootstrap(rows: DataFrame, id_: str, base: str, other: str, replicates: int, seed: int) -> DataFrame:
    """The mean difference of two columns of a row with its interval; both sides share the draws."""
    return bootstrap(rows.withColumn("_d", F.col(other) - F.col(base)).withColumn("_one", F.lit(1.0)), id_, "_d", "_one", replicates, seed)


def significance(low: Column, high: Column) -> Column:
    return F.when(low > 0, "primary_higher").when(high < 0, "primary_lower").otherwise("interval_includes_zero")


def sliced(rows: DataFrame, slices: Column, *aggregates: Column) -> DataFrame:
    """Aggregates over overlapping slices: ``slices`` is the array of a row's slice names."""
    return rows.withColumn("slice", F.explode(slices)).groupBy("slice").agg(*aggregates)


def issues(rows: DataFrame, keys: list[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """A row (keys, code, severity) for each broken rule; ``rules``: code to (severity, condition that is broken)."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for code, (s, c) in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("i")).select(*keys, "i.code", "i.severity")


def ordered_digest(values: Column) -> Column:
    return F.sha2(F.array_join(values, "\n"), 256)
