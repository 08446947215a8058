"""Scoring of candidates by models: the interface, a linear stand-in, score modes, and losses as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import minmax_over


def linear(features: Column, weights: list[float], bias: float = 0.0) -> Column:
    """A linear model over an array column: what runs where no neural scorer is installed."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)


def interaction(a: Column, b: Column) -> Column:
    """[a, b, a x b, |a - b|] of two vectors."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def policy(scores: DataFrame, mode: str, weight: float = 0.5, by: str = "qid") -> DataFrame:
    """policy_score by mode: rank, deficit (role x deficit), contribution (scaled contribution x deficit), blend (with front)."""
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if mode == "rank":
        out = F.col("score")
    elif mode == "deficit":
        out = minmax_over("score", by) + weight * product(F.col("roles"), F.col("deficits"))
    elif mode == "contribution":
        scores = scores.withColumn("_c", product(F.col("contributions"), F.col("deficits")))
        out = minmax_over("score", by) + weight * minmax_over("_c", by)
    elif mode == "blend":
        out = weight * minmax_over("score", by) + (1 - weight) * minmax_over("front", by)
    else:
        raise ValueError(mode)
    return scores.withColumn("policy_score", F.round(out, 6)).drop("_c")


def losses(scores: DataFrame, margin: float = 0.2) -> DataFrame:
    """(qid, ce, hinge): softmax cross-entropy of the positive and mean hinge of the others. Needs qid, score, label."""
    w = Window.partitionBy("qid")
    with_positive = scores.withColumn("_p", F.max(F.when(F.col("label") == 1, F.col("score"))).over(w)).withColumn("_m", F.max("score").over(w))
    ce = F.log(F.sum(F.exp(F.col("score") - F.col("_m")))) + F.max("_m") - F.max("_p")
    hinge = F.avg(F.when(F.col("label") == 0, F.greatest(F.lit(0.0), margin - F.col("_p") + F.col("score"))))
    return with_positive.where("_p is not null").groupBy("qid").agg(F.round(ce, 6).alias("ce"), F.round(hinge, 6).alias("hinge"))


def flatten(samples: DataFrame) -> DataFrame:
    """(qid, t, pos, unit, label) of every candidate of a sample (qid, t, positive, candidates)."""
    out = samples.select("qid", "t", "positive", F.posexplode("candidates").alias("pos", "unit"))
    return out.select("qid", "t", "pos", "unit", (F.col("unit") == F.col("positive")).cast("int").alias("label"))
