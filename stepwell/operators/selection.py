"""Selectors, seeds and the teacher's choice among candidates and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import gates, retrieval
from .teacher import SIMILAR

#: Fixed values of the Okapi form with a floor for negative idf.
OKAPI_K1, OKAPI_B, OKAPI_EPSILON = 1.5, 0.75, 0.25
#: Characters of a task's texts, each word of which becomes a row.
OKAPI_CHARS = 8 << 20


def okapi(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, doc, score) over the candidates (qid, doc, text) of each question (qid, text).

    idf = ln(N - df + .5) - ln(df + .5), where it is negative a quarter of the mean idf of the
    collection's terms; a question's token counts as often as it occurs.
    """
    # texts meet their question once; what follows stays in the task of the question
    asked = questions.select("qid", F.lit(None).cast(docs.schema["doc"].dataType).alias("doc"), "text", F.lit(True).alias("_q"))
    met = docs.select("qid", "doc", "text", F.lit(False).alias("_q")).unionByName(asked)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    met = met.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // OKAPI_CHARS)), "qid")
    words = met.select("qid", "doc", "_q", T.tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    stats = docs.select("qid", F.size(T.tokens(F.col("text"))).alias("dl")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = words.select("qid", "doc", "_q", "dl", F.explode("w").alias("term")).groupBy("qid", "doc", "_q", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).join(stats, "qid")
    term, held = Window.partitionBy("qid", "term"), ~F.col("_q")
    df = tf.withColumns({"df": F.count_if(held).over(term), "times": F.sum(F.when(F.col("_q"), F.col("tf"))).over(term), "_i": F.row_number().over(term.orderBy("_q", "doc"))})
    df = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    df = df.withColumn("mean", F.avg(F.when(held & (F.col("_i") == 1), F.col("idf"))).over(Window.partitionBy("qid"))).where(held & F.col("times").isNotNull())
    idf = F.when(F.col("idf") < 0, OKAPI_EPSILON * F.col("mean")).otherwise(F.col("idf"))
    part = F.col("times") * idf * F.col("tf") * (OKAPI_K1 + 1) / (F.col("tf") + OKAPI_K1 * (1 - OKAPI_B + OKAPI_B * F.col("dl") / F.col("avgdl")))
    found = df.groupBy("qid", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    return docs.select("qid", "doc").join(found.hint("merge"), ["qid", "doc"], "left").select("qid", "doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def seed_units(chunks: DataFrame, atoms: DataFrame, questions: DataFrame, shortlist: int, k: int) -> DataFrame:
    """(qid, unit, score, rank): the best atom of each shortlisted chunk by BM25 within the chunk plus the chunk's coarse score.

    ``chunks``: qid, chunk, summary, text; ``atoms``: qid, chunk, unit, text; ``questions``: qid,
    text. The coarse score is half the summary's, half the chunk's.
    """
    asked = questions.withColumnRenamed("qid", "g").withColumn("qid", F.col("g"))
    halves = [retrieval.bm25(chunks.select(F.col("qid").alias("g"), F.col("chunk").alias("doc"), F.col(c).alias("text")), asked, "g").select("qid", "doc", (F.col("score") / 2).alias("score")) for c in ("summary", "text")]
    scored = halves[0].unionByName(halves[1]).groupBy("qid", "doc").agg(F.sum("score").alias("coarse"))
    all_ = chunks.select("qid", F.col("chunk").alias("doc")).join(scored, ["qid", "doc"], "left").select("qid", F.col("doc").alias("chunk"), F.coalesce("coarse", F.lit(0.0)).alias("coarse"))
    short = all_.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("coarse"), "chunk"))).where(F.col("at") <= shortlist).drop("at")
    group = F.struct("qid", "chunk").alias("g")
    own = atoms.join(short, ["qid", "chunk"]).select(group, F.col("unit").alias("doc"), "text", "coarse")
    per_chunk = short.join(questions, "qid").select(group, F.struct("qid", "chunk").alias("qid"), "text")
    fine = retrieval.bm25(own.select("g", "doc", "text"), per_chunk, "g").select(F.col("qid").alias("g"), "doc", "score")
    merged = own.select("g", "doc", "coarse").join(fine, ["g", "doc"], "left").select("g", F.col("doc").alias("unit"), F.round(F.coalesce("score", F.lit(0.0)) + F.col("coarse"), 6).alias("score"))
    best = merged.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "unit"))).where("at = 1")
    return retrieval.top_k(best.select(F.col("g.qid").alias("qid"), "unit", "score"), k, unit="unit")


def multi_query_max(scores: DataFrame) -> DataFrame:
    """(qid, unit, score): the largest score over the variants of a query; ``scores``: qid, variant, unit, score."""
    return scores.groupBy("qid", "unit").agg(F.max("score").alias("score"))


def choose_first(pool: DataFrame, k: int) -> DataFrame:
    """The first k of each pool (qid, unit, pos) as given; pos anew from 1."""
    return _numbered(pool, F.col("pos")).where(F.col("pos") <= k)


def choose_random(pool: DataFrame, k: int, seed: int) -> DataFrame:
    """k of each pool (qid, unit, pos) in a hash order of seed, question and unit."""
    return _numbered(pool, T.stable_key(seed, F.concat_ws("::", F.col("qid").cast("string"), F.col("unit").cast("string")))).where(F.col("pos") <= k)


def _numbered(pool: DataFrame, order: Column) -> DataFrame:
    return pool.select("qid", "unit", F.row_number().over(Window.partitionBy("qid").orderBy(order, "unit")).alias("pos"))


#: The ways to cut a front end's candidates.
COMPRESSIONS = ("rrf_top30", "rrf_local_mmr10", "bge_top10", "no_compression", "oracle_target_preserving_mmr10")


def compression_variants(front: DataFrame, pool_k: int = 30, top_k: int = 10) -> DataFrame:
    """(variant, qid, unit, pos): what each way keeps of ``front`` (qid, unit, rrf_rank, dense_rank, mmr_rank or null, positive).

    The last way is the third list with the gold unit in its last place if it has none.
    """
    whole = Window.partitionBy("qid")
    front = front.withColumn("_size", F.max("mmr_rank").over(whole)).withColumn("_holds", F.coalesce(F.max((F.col("mmr_rank").isNotNull() & F.col("positive")).cast("int")).over(whole), F.lit(0)) == 1)
    rank, last = F.col("mmr_rank"), F.col("mmr_rank") == F.col("_size")
    oracle = F.when(F.col("_holds"), rank).when(F.col("positive"), F.coalesce("_size", F.lit(1))).when(~last, rank)
    places = [F.when(F.col("rrf_rank") <= pool_k, F.col("rrf_rank")), rank, F.when(F.col("dense_rank") <= top_k, F.col("dense_rank")), F.col("rrf_rank"), oracle]
    each = F.array(*(F.struct(F.lit(n).alias("variant"), p.cast("int").alias("pos")) for n, p in zip(COMPRESSIONS, places)))
    return front.select("qid", "unit", F.explode(each).alias("v")).select("v.variant", "qid", "unit", "v.pos").where("pos is not null")


def teacher_choice(candidates: DataFrame) -> DataFrame:
    """The candidate of each state (qid, t) that comes first: by utility, raw before notes, facing the answer, closure, cost, priority, id.

    Columns beside qid, t and unit: utility, raw, answer_facing, closure, kappa, priority. Closure
    and priority count for notes only, and a later priority comes first.
    """
    of_note = lambda c: F.when(F.col("raw"), 0).otherwise(F.col(c))
    order = [F.desc("utility"), F.desc("raw"), F.desc("answer_facing"), F.desc(of_note("closure")), F.asc("kappa"), F.desc(of_note("priority")), F.asc(F.col("unit").cast("string"))]
    return candidates.withColumn("_at", F.row_number().over(Window.partitionBy("qid", "t").orderBy(*order))).where("_at = 1").drop("_at")


def composable(texts: Column, parents: Column, raw: Column) -> Column:
    """Whether the first three units hold two raw ones that are no near copies and of different parents (arrays in order)."""
    zipped = F.slice(F.transform(F.arrays_zip(texts.alias("x"), parents.alias("p"), raw.alias("r")), lambda z: F.struct(F.coalesce(z["x"], F.lit("")).alias("x"), F.coalesce(z["p"], F.lit("")).alias("p"), F.coalesce(z["r"], F.lit(False)).alias("r"))), 1, 3)
    apart = lambda kept, u: F.forall(kept, lambda k: T.jaccard(T.tokens(k["x"]), T.tokens(u["x"])) < SIMILAR)
    usable = F.aggregate(zipped, F.slice(zipped, 1, 0), lambda kept, u: F.when(u["r"] & apart(kept, u), F.concat(kept, F.array(u))).otherwise(kept))
    return F.aggregate(usable, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("p")), lambda s, u: F.struct((s["n"] + 1).alias("n"), F.when(u["p"] == "", s["p"]).otherwise(F.array_union(s["p"], F.array(u["p"]))).alias("p")), lambda s: (s["n"] >= 2) & (F.size(s["p"]) >= 2))


def bridgeable(question: Column, texts: Column, state_anchors: Column) -> Column:
    """Whether a pair of the first three texts shares an anchor with each other or the state, touches the question, and shows the answer type."""
    kind, asked = T.focus_kind(question), T.anchors(question)
    top = F.transform(F.slice(texts, 1, 3), lambda x: F.struct(T.anchors(x).alias("a"), gates.answer_signal(x, kind).alias("s")))
    joined = lambda x, y: F.arrays_overlap(x["a"], y["a"]) | F.arrays_overlap(F.array_union(x["a"], y["a"]), state_anchors)
    pairs = F.flatten(F.transform(top, lambda x, i: F.transform(F.slice(top, i + 2, 3), lambda y: joined(x, y) & F.arrays_overlap(F.array_union(x["a"], y["a"]), asked) & (x["s"] | y["s"]))))
    return F.exists(pairs, lambda p: F.coalesce(p, F.lit(False)))


def target_hint(context: Column, doc: Column, text: Column) -> Column:
    """Whether a context names the target's document, one of its first eight anchors of several words, or two of them."""
    have, title = T.normalize(F.coalesce(context, F.lit(""))), T.normalize(F.coalesce(doc, F.lit("")))
    first = F.transform(F.slice(T.anchors(F.concat_ws(" ", doc, text)), 1, 8), T.normalize)
    hits = F.filter(first, lambda a: (F.length(a) >= 4) & F.contains(have, a))
    return (have != "") & (((title != "") & F.contains(have, title)) | (F.size(hits) >= 2) | F.exists(hits, lambda a: F.contains(a, F.lit(" "))))


def hard_record(policy_rank: Column, kept_rank: Column, least: int, most: int) -> Column:
    """Gold that the policy ranks late and compression early; false where either rank is missing."""
    return F.coalesce((policy_rank >= least) & (kept_rank <= most), F.lit(False))


def best_unit(question: Column, units: Column) -> Column:
    """The unit of a target chunk to show, of an array of (unit, doc, text, sent): answer type, anchors, tokens shared, earlier sentence, id."""
    kind, asked, words = T.focus_kind(question), T.anchors(question), T.tokens(question)
    whole = lambda u: F.concat_ws(" ", u["doc"], u["text"])
    keyed = F.transform(
        units,
        lambda u: F.struct(gates.answer_signal(whole(u), kind).cast("int"), F.size(F.array_intersect(T.anchors(whole(u)), asked)), F.size(F.array_intersect(T.tokens(whole(u)), words)), -u["sent"], u["unit"].alias("unit")),
    )
    return F.array_max(keyed)["unit"]


def repair_note(notes: Column) -> Column:
    """The note to inject, of an array of (unit, type, answer_facing, closure): facing the answer, closure, a verification note, id."""
    keyed = F.transform(notes, lambda n: F.struct(F.coalesce(n["answer_facing"], F.lit(False)).cast("int"), n["closure"], (n["type"] == "verification_note").cast("int"), n["unit"].alias("unit")))
    return F.array_max(keyed)["unit"]
