"""The front end rebuilt for finished samples: two channels, fusion, expansion, MMR and the final candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R
from .rewrite import placed
from .selection import okapi

#: The ranked channels, in the order of their turns.
CHANNELS = ("bm25", "dense", "rrf")


def rebuild(
    pool: DataFrame, dense: DataFrame, questions: DataFrame, positives: DataFrame, front_k: int = 30, top_k: int = 10, window: int = 1,
    lambda_: float = 0.7, same_doc: float = 0.5, force: bool = True, source: str = "mixed", hard: int = 2,
) -> DataFrame:
    """A row for each question: candidates (units in order) and how they came about.

    ``pool``: qid, unit, doc, sent_id, text. ``dense``: qid, unit, score. ``questions``: qid, text.
    ``positives``: qid, unit, in the pool. Columns: qid, candidates, bm25_rank, dense_rank and
    rrf_rank of the positive, natural (whether MMR took it by itself), forced, hard (units, in
    order). Equal scores rank by unit. Ranks, expansion and layers are windows of one table of the
    questions' pools, so that nothing is scored twice; a pool is what retrieval left of a question.
    """
    by, doc = Window.partitionBy("qid"), Window.partitionBy("qid", "doc")
    place = lambda *order: F.row_number().over(by.orderBy(*order, "unit"))
    lexical = okapi(pool.select("qid", F.col("unit").alias("doc"), "text"), questions).select("qid", F.col("doc").alias("unit"), F.col("score").alias("_lexical"))
    met = lambda left, right, how="inner": left.join(right.hint("merge"), ["qid", "unit"], how)  # noqa: E731  all sides lie by question, so none goes through the driver
    rows = met(met(pool, lexical), dense.select("qid", "unit", F.col("score").alias("_dense")))
    rows = met(rows, positives.select("qid", "unit", F.lit(True).alias("_own")), "left").withColumn("positive", F.coalesce("_own", F.lit(False)))
    rows = rows.withColumn("bm25", place(F.desc("_lexical"))).withColumn("dense", place(F.desc("_dense")))
    rows = rows.withColumn("relevance", F.round(1 / (R.RRF_K + F.col("bm25")) + 1 / (R.RRF_K + F.col("dense")), 6)).withColumn("rrf", place(F.desc("relevance")))
    seed = (F.col("bm25") <= front_k) | (F.col("dense") <= front_k)
    rows = rows.withColumn("near", F.max(seed).over(doc.orderBy("sent_id").rangeBetween(-window, window)))
    turn = lambda c, i: F.struct(F.col(c).alias("p"), F.lit(i).alias("l"))  # noqa: E731  whose turn a unit has in the round-robin
    order = F.least(*(turn(c, i) for i, c in enumerate(CHANNELS))) if source == "mixed" else turn(source, 0)
    open_ = F.col("near") & ~F.col("positive")
    rows = rows.withColumn("_hard", F.when(open_, place(F.desc(open_), order))).withColumn("hard", F.when(F.col("_hard") <= hard, F.col("_hard")))
    chosen = R.mmr(rows.where("near").select("qid", "unit", "doc", "text", "relevance"), top_k, lambda_, same_doc).where(F.col("pos") <= top_k)
    rows = met(rows.drop("text"), chosen.select("qid", "unit", F.col("pos").alias("mmr")), "left")
    layer = lambda n, p: F.when(p.isNotNull(), F.struct(F.lit(n).alias("l"), p.cast("int").alias("p")))
    forced = [layer(2, F.when(F.col("positive"), F.lit(0)))] if force else []
    rows = rows.withColumn("at", F.least(layer(0, F.col("hard")), layer(1, F.col("mmr")), layer(3, F.col("rrf")), *forced))
    own = lambda c: F.max(F.when(F.col("positive"), c)).over(by)
    rows = rows.select("qid", "unit", "at", "positive", "hard", *(own(F.col(c)).alias(f"{c}_rank") for c in CHANNELS), own(F.col("mmr").isNotNull()).alias("natural"))
    rows = rows.withColumn("_hard", F.collect_list(F.when(F.col("hard").isNotNull(), F.struct("hard", "unit"))).over(by)).where(F.col("bm25_rank").isNotNull())
    names = lambda c: F.transform(F.array_sort(c), lambda x: x["unit"])
    first = lambda c: F.first(c).alias(c)
    out = placed(rows, top_k, force).groupBy("qid").agg(names(F.collect_list(F.struct("pos", "unit"))).alias("candidates"), *map(first, ("bm25_rank", "dense_rank", "rrf_rank", "natural", "_hard")))
    return out.select("qid", "candidates", "bm25_rank", "dense_rank", "rrf_rank", "natural", (~F.col("natural") & F.lit(force)).alias("forced"), names(F.col("_hard")).alias("hard"))
