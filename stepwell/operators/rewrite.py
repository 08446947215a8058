"""Candidate composition, dataset rewriters and audits of finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import interleave
from .trajectories import cyclic_next, step_window


def hard_negatives(expanded: DataFrame, channels: dict[str, DataFrame], positives: DataFrame, source: str, count: int) -> DataFrame:
    """(qid, unit, pos): the first ``count`` units of a channel, or of all interleaved, that are in the expansion and not the positive."""
    order = interleave(list(channels.values())) if source == "mixed" else channels[source].select("qid", "unit", "pos")
    kept = order.join(expanded.select("qid", "unit").distinct(), ["qid", "unit"], "left_semi").join(positives.select("qid", "unit"), ["qid", "unit"], "left_anti")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "unit"))).where(F.col("pos") <= count)


def compose(hard: DataFrame, mmr: DataFrame, front: DataFrame, positives: DataFrame, target: int, require: bool = True) -> DataFrame:
    """Final candidates (qid, unit, pos): hard negatives, then MMR, then front order, cut to ``target``; the positive is forced in.

    A positive that the hard negatives and MMR lack comes right after them, or takes the last
    place when they fill the list.
    """
    rank = lambda f, n: f.select("qid", "unit", F.struct(F.lit(n).alias("l"), F.col("pos").cast("int").alias("p")).alias("at"))
    listed = rank(hard, 0).unionByName(rank(mmr, 1)).unionByName(rank(front, 3))
    if require:
        listed = listed.unionByName(positives.select("qid", "unit", F.struct(F.lit(2).alias("l"), F.lit(0).alias("p")).alias("at")))
    first = listed.groupBy("qid", "unit").agg(F.min("at").alias("at"))
    marked = first.join(positives.select("qid", "unit", F.lit(True).alias("positive")), ["qid", "unit"], "left")
    return placed(marked, target, require).select("qid", "unit", "pos")


def composed(units: DataFrame, channels: list[str], mmr: Column, front: str, count: int, target: int) -> DataFrame:
    """What `hard_negatives` of all channels interleaved and `compose` give, (qid, unit, pos), of one table of the questions' units.

    ``units``: qid, unit, each once, whether it is ``expanded`` and ``positive``, and its place in
    each of the channels. ``mmr`` is the place after MMR, null where it was left out; ``front``
    names the channel of the front order. All is windows of a question, so rows move once.
    """
    place = lambda *order: F.row_number().over(Window.partitionBy("qid").orderBy(*order, "unit"))
    turn = F.least(*(F.struct(F.col(c).cast("int").alias("p"), F.lit(i).alias("l")) for i, c in enumerate(channels)))
    open_ = F.col("expanded") & ~F.col("positive")
    rows = units.withColumn("_hard", F.when(open_, place(F.desc(open_), turn)))
    layer = lambda n, p: F.when(p.isNotNull(), F.struct(F.lit(n).alias("l"), p.cast("int").alias("p")))
    at = F.least(layer(0, F.when(F.col("_hard") <= count, F.col("_hard"))), layer(1, mmr), layer(2, F.when(F.col("positive"), F.lit(0))), layer(3, F.col(front)))
    return placed(rows.select("qid", "unit", "positive", at.alias("at")), target, True).select("qid", "unit", "pos")


def placed(listed: DataFrame, target: int, require: bool) -> DataFrame:
    """The first ``target`` rows of (qid, unit, at, positive) by ``at`` with pos; a required positive that comes later takes the last place."""
    pos = listed.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("at", "unit")))
    if not require:
        return pos.where(F.col("pos") <= target)
    own = F.coalesce("positive", F.lit(False))
    late = F.coalesce(F.max(F.when(own, F.col("pos"))).over(Window.partitionBy("qid")) > target, F.lit(False))
    kept = pos.withColumn("_late", late).where(own | (F.col("pos") < F.when(F.col("_late"), target).otherwise(target + 1)))
    return kept.withColumn("pos", F.when(own, F.least("pos", F.lit(target))).otherwise(F.col("pos"))).drop("_late")


def candidate_pool(units: DataFrame, positives: DataFrame, most: int, seed: int) -> DataFrame:
    """(qid, unit, pos): the positive and hash-ordered others up to ``most``, in the order of the next seed."""
    key = lambda s: T.stable_key(s, F.concat_ws("::", F.col("qid").cast("string"), F.col("unit").cast("string")))
    marked = units.join(positives.select("qid", "unit", F.lit(1).alias("own")), ["qid", "unit"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    some = marked.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("own"), key(seed)))).where(F.col("_n") <= most)
    return some.select("qid", "unit", F.row_number().over(Window.partitionBy("qid").orderBy(key(seed + 1))).alias("pos"))


def fixed_pool(units: DataFrame, most: int, seed: int) -> DataFrame:
    """(qid, unit, pos): gold first, others by (gold document, answer visible, overlap, hash); in hash order in the end."""
    key = lambda s: T.stable_key(s, F.concat_ws("::", F.col("qid").cast("string"), F.col("unit").cast("string")))
    order = Window.partitionBy("qid").orderBy(F.desc("gold"), F.desc("gold_doc"), F.desc("visible"), F.desc("overlap"), key(seed))
    some = units.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return some.select("qid", "unit", F.row_number().over(Window.partitionBy("qid").orderBy(key(seed + 1))).alias("pos"))


def acquired(history: Column, pool: Column, positive: Column, last_only: bool = False) -> Column:
    """Units of the history that are still in the pool, without the positive; or of its last step alone."""
    some = F.slice(history, -1, 1) if last_only else history
    return F.array_except(F.array_intersect(F.when(F.size(history) > 0, some).otherwise(history), pool), F.array(positive))


def first_unresolved(gold: Column, taken: Column) -> Column:
    """The first gold unit not taken yet; null when all are."""
    return F.try_element_at(F.filter(gold, lambda g: ~F.array_contains(taken, g)), F.lit(1))


def step_mismatches(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(qid, t, reason) of steps that two runs don't share or whose targets differ."""
    x, y = a.select("qid", "t", F.col(column).alias("x")), b.select("qid", "t", F.col(column).alias("y"))
    both = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), ["qid", "t"], "full")
    reason = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(~F.col("x").eqNullSafe(F.col("y")), "different")
    return both.select("qid", "t", reason.alias("reason")).where("reason is not null")


def other_question(rows: DataFrame) -> DataFrame:
    """(qid, t, other): for each step the next question by order that has the same t, the last with the first."""
    return cyclic_next(rows, "qid", "t").select("qid", "t", F.col("paired").alias("other"))


def state_breaks(states: DataFrame) -> DataFrame:
    """Steps whose state before isn't the state after the step before: qid, t. Needs before and after."""
    return states.withColumn("_p", F.lag("after").over(step_window())).where("_p is not null and not (_p <=> before)").select("qid", "t")


def rank_reversals(pairs: DataFrame) -> DataFrame:
    """(qid, t, reversed): whether the order of a pair's two scores turns between consecutive states."""
    sign = F.signum(F.col("a") - F.col("b"))
    w = Window.partitionBy("qid", "pair").orderBy("t")
    return pairs.withColumn("_s", sign).withColumn("_n", F.lead("_s").over(w)).where("_n is not null").select("qid", "pair", "t", (F.col("_s") * F.col("_n") < 0).cast("int").alias("reversed"))


def similar_pairs(units: DataFrame, same_doc: float = 0.5) -> DataFrame:
    """(qid, a, b, similarity) of the candidates that share a token within a qid; token Jaccard, ``same_doc`` at least within a document.

    Pairs meet on their tokens, so those without any in common are never formed; they are 0, or
    ``same_doc``.
    """
    bags = units.select("qid", "unit", "doc", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    words = bags.select("qid", "unit", F.size("w").alias("n"), F.explode("w").alias("x"))
    other = words.select("qid", "x", F.col("unit").alias("b"), F.col("n").alias("m"))
    hits = words.join(other, ["qid", "x"]).where("unit < b").groupBy("qid", F.col("unit").alias("a"), "b", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    docs = bags.select("qid", F.col("unit").alias("a"), F.col("doc").alias("da"))
    full = hits.join(docs, ["qid", "a"]).join(docs.select("qid", F.col("a").alias("b"), F.col("da").alias("db")), ["qid", "b"])
    j = F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    return full.select("qid", "a", "b", F.round(F.greatest(j, F.when(F.col("da") == F.col("db"), same_doc).otherwise(0.0)), 6).alias("similarity"))
