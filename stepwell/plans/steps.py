"""Queries over trajectories: joins, windows, states and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import scorers, statistics, teacher
from ..operators import trajectories as J
from .registry import STEPS, query, steps, table

W_STEP = "(PARTITION BY qid ORDER BY t)"


@query(f"""WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM steps)
SELECT qid, unit, score, rank FROM r WHERE rank <= 3""")
def rank_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(steps(spark, sf_dir), 3, unit="unit").select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {STEPS}, r AS (SELECT qid, role, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM steps),
g AS (SELECT qid, min(rank) FILTER (role = 'support') AS positive_rank,
 round(max(score) FILTER (role = 'support') - max(score) FILTER (role <> 'support'), 6) AS margin FROM r GROUP BY qid)
SELECT qid, positive_rank, margin, CASE WHEN positive_rank IS NULL THEN 'missing' WHEN positive_rank <= 1 THEN '1' WHEN positive_rank <= 2 THEN '<=2'
 WHEN positive_rank <= 3 THEN '<=3' WHEN positive_rank <= 5 THEN '<=5' WHEN positive_rank <= 10 THEN '<=10' WHEN positive_rank <= 20 THEN '<=20'
 WHEN positive_rank <= 30 THEN '<=30' WHEN positive_rank <= 50 THEN '<=50' ELSE '>50' END AS bucket FROM g""")
def positive_rank_and_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = steps(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "unit")).cast("long"))
    gold = F.col("role") == "support"
    out = ranked.groupBy("qid").agg(F.min(F.when(gold, F.col("rank"))).alias("positive_rank"), F.round(F.max(F.when(gold, F.col("score"))) - F.max(F.when(~gold, F.col("score"))), 6).alias("margin"))
    return out.withColumn("bucket", T.rank_bucket(F.col("positive_rank")))


@query(f"""WITH {STEPS} SELECT qid, t, unit, lag(unit) OVER {W_STEP} AS previous_unit, lead(unit) OVER {W_STEP} AS next_unit FROM steps""")
def adjacent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.neighbours(steps(spark, sf_dir), "unit").select("qid", "t", "unit", "previous_unit", "next_unit")


@query(f"""WITH {STEPS} SELECT qid, t, coalesce(len(list(unit) OVER w), 0) AS prefix_units, coalesce(array_to_string(list(unit ORDER BY t) OVER w, ','), '') AS prefix
FROM steps WINDOW w AS (PARTITION BY qid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_prefix(steps(spark, sf_dir)).select("qid", "t", F.size("prefix").cast("long").alias("prefix_units"), F.array_join(F.transform("prefix", lambda x: x.cast("string")), ",").alias("prefix"))


@query(f"""WITH {STEPS}, f AS (SELECT qid, t, CASE WHEN role = 'support' THEN 1 ELSE 0 END AS flag FROM steps),
g AS (SELECT *, sum(flag) OVER (PARTITION BY qid) AS total, sum(flag) OVER (PARTITION BY qid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead,
 count(flag) OVER w2 AS n2, sum(flag) OVER w2 AS s2, max(CASE WHEN flag = 1 THEN t END) OVER (PARTITION BY qid ORDER BY t ROWS UNBOUNDED PRECEDING) AS last_progress
 FROM f WINDOW w2 AS (PARTITION BY qid ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT qid, t, round(CASE WHEN total > 0 THEN ahead / total ELSE 0 END, 6) AS remaining, (n2 = 2 AND s2 = 0) AS stalled, last_progress FROM g""")
def progress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = steps(spark, sf_dir).withColumn("flag", (F.col("role") == "support").cast("int"))
    return flagged.select("qid", "t", F.round(J.remaining_ratio("flag"), 6).alias("remaining"), J.stalled("flag").alias("stalled"), J.last_progress("flag").alias("last_progress"))


@query(f"""WITH {STEPS}, p AS (SELECT qid, t, list(unit) OVER (PARTITION BY qid ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r FROM steps),
q AS (SELECT *, lag(r, 1) OVER {W_STEP} AS r1, lag(r, 2) OVER {W_STEP} AS r2 FROM p)
SELECT qid, t, round(greatest(CASE WHEN r1 IS NULL THEN 0 ELSE len(list_intersect(r, r1)) / len(list_distinct(list_concat(r, r1))) END,
 CASE WHEN r2 IS NULL THEN 0 ELSE len(list_intersect(r, r2)) / len(list_distinct(list_concat(r, r2))) END), 6) AS repeat_ratio FROM q""")
def retrieval_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = steps(spark, sf_dir).withColumn("r", F.collect_list("unit").over(J.step_window().rowsBetween(-2, 0)))
    lists = lists.withColumn("r1", F.lag("r", 1).over(J.step_window())).withColumn("r2", F.lag("r", 2).over(J.step_window()))
    like = lambda c: F.coalesce(T.jaccard(F.col("r"), F.col(c)), F.lit(0.0))
    return lists.select("qid", "t", F.round(F.greatest(like("r1"), like("r2")), 6).alias("repeat_ratio"))


@query(f"""WITH {STEPS}, r AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY t DESC) AS back FROM steps)
SELECT qid, round(sum(score), 2) AS tail_score, count(*) AS n FROM r WHERE back <= 3 GROUP BY qid""")
def tail_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("t")))
    return steps(spark, sf_dir).withColumn("back", back).where("back <= 3").groupBy("qid").agg(F.round(F.sum("score"), 2).alias("tail_score"), F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT l_orderkey AS qid, l_linenumber - 1 AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS n FROM lineitem)
SELECT qid, min(CASE WHEN t = n THEN 1 ELSE 0 END)::INTEGER AS ok FROM n GROUP BY qid""")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")) - 1
    return lines.select(F.col("l_orderkey").alias("qid"), ((F.col("l_linenumber") - 1) == n).cast("int").alias("same")).groupBy("qid").agg(F.min("same").alias("ok"))


@query(f"""WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, unit ORDER BY t) AS n FROM steps) SELECT qid, unit, t, score FROM r WHERE n = 1""")
def canonical_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.keep_first(steps(spark, sf_dir), ["qid", "unit"], ["t"]).select("qid", "unit", "t", "score")


@query("""SELECT l_orderkey AS qid, l_linenumber AS line, count(DISTINCT (l_partkey, l_suppkey)) AS signatures FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1""")
def conflicting_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey")
    return J.conflicts(rows, ["qid", "line"], ["l_partkey", "l_suppkey"])


_LEDGER = f"""{STEPS}, o AS (SELECT *, (row_number() OVER (PARTITION BY qid, unit ORDER BY t) = 1)::INTEGER AS is_new FROM steps),
k AS (SELECT *, {", ".join(f"coalesce(sum(CASE WHEN role = '{r}' AND is_new = 1 THEN 1.0::DOUBLE ELSE 0 END) OVER w, 0) AS k_{r}" for r in J.ROLES)}
 FROM o WINDOW w AS (PARTITION BY qid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT qid, {", ".join(f"sum(CASE WHEN role = '{r}' AND is_new = 1 THEN 1.0::DOUBLE ELSE 0 END) AS n_{r}" for r in J.ROLES)} FROM o GROUP BY qid),
d AS (SELECT k.qid, t, unit, role, is_new, {", ".join(f"CASE WHEN n_{r} <= 0 THEN 0.0::DOUBLE ELSE round(1 - (k_{r} + 1) / (n_{r} + 2), 6) END AS d_{r}" for r in J.ROLES)} FROM k JOIN n USING (qid))"""


def _deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = steps(spark, sf_dir).withColumn("weight", F.lit(1.0))
    once = J.first_use(own)
    totals = once.groupBy("qid").agg(*[F.sum(F.when((F.col("role") == r) & (F.col("is_new") == 1), 1.0).otherwise(0.0)).alias(f"n_{r}") for r in J.ROLES])
    return J.deficits(own, totals)


@query(f"WITH {_LEDGER} SELECT qid, t, unit, role, is_new, {', '.join(f'd_{r}' for r in J.ROLES)} FROM d")
def typed_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deficits(spark, sf_dir)


@query(f"""WITH {_LEDGER} SELECT qid, t, {", ".join(f"round(greatest(0.0::DOUBLE, d_{r} - coalesce(lead(d_{r}) OVER {W_STEP}, CASE WHEN qid % 2 = 0 THEN 0.0::DOUBLE END, d_{r})), 6) AS c_{r}" for r in J.ROLES)} FROM d""")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.contributions(_deficits(spark, sf_dir), F.col("qid") % 2 == 0).select("qid", "t", *[f"c_{r}" for r in J.ROLES])


@query(f"""WITH {_LEDGER}, p AS (SELECT d_support AS v, lag(d_support) OVER {W_STEP} AS b FROM d)
SELECT round(avg(CASE WHEN v <= b + 1e-9 THEN 1.0 ELSE 0 END), 6) AS rate, count(*) AS pairs FROM p WHERE b IS NOT NULL""")
def deficit_monotone_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.monotone_rate(_deficits(spark, sf_dir), "d_support")


@query(f"""WITH {STEPS}, m AS (SELECT qid, max(t) AS last FROM steps GROUP BY qid)
SELECT s.qid, t, CASE WHEN s.qid % 3 = 0 AND t = last THEN 'terminal' WHEN discount > 0.08 THEN 'false-stop' WHEN s.qid % 3 = 0 AND last - t IN (1, 2) THEN 'near-terminal' ELSE 'continue' END AS stop_type,
 (CASE WHEN s.qid % 3 = 0 AND t = last THEN 1 ELSE 0 END)::INTEGER AS stop_label FROM steps s JOIN m USING (qid)""")
def stop_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = J.stop_label(F.col("qid") % 3 == 0, F.max("t").over(J.whole_window()), F.col("t"), F.col("discount") > 0.08)
    return steps(spark, sf_dir).select("qid", "t", kind.alias("stop_type")).withColumn("stop_label", (F.col("stop_type") == "terminal").cast("int"))


@query(f"""WITH {STEPS}, c AS (SELECT qid, list(DISTINCT unit) AS candidates FROM steps GROUP BY qid)
SELECT qid, t, unit AS positive, len(candidates) - 1 AS negatives FROM steps JOIN c USING (qid)""")
def ranking_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = steps(spark, sf_dir)
    pools = own.groupBy("qid").agg(F.collect_set("unit").alias("candidates"))
    return own.join(pools, "qid").select("qid", "t", F.col("unit").alias("positive"), F.size(J.ranking_negatives(F.col("candidates"), F.col("unit"))).cast("long").alias("negatives"))


@query(f"""WITH {STEPS}, f AS (SELECT qid, min(t) AS added, count(*) AS n, unit FROM steps GROUP BY qid, unit), l AS (SELECT qid, max(t) AS last FROM steps GROUP BY qid)
SELECT f.qid, unit, added AS added_step, n AS times FROM f""")
def folded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = J.fold_state(steps(spark, sf_dir))
    last = states.withColumn("_last", F.max("t").over(J.whole_window())).where("t = _last")
    return last.select("qid", F.explode("raw_refs").alias("r")).select("qid", F.col("r.unit").alias("unit"), F.col("r.added_step").alias("added_step"), F.col("r.count").cast("long").alias("times"))


@query(f"""WITH {STEPS}, e AS (SELECT qid, list('[' || n || '] unit: ' || unit ORDER BY n) AS lines FROM (
 SELECT qid, unit, row_number() OVER (PARTITION BY qid ORDER BY t DESC) AS n FROM steps) WHERE n <= 8 GROUP BY qid) SELECT qid, array_to_string(lines, chr(10)) AS notebook FROM e""")
def rendered_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.collect_list(F.struct(F.col("t").alias("added_step"), F.lit(1).alias("count"), F.lit("unit").alias("title"), F.col("unit").cast("string").alias("text")))
    return steps(spark, sf_dir).groupBy("qid").agg(entries.alias("e")).select("qid", J.notebook(F.col("e")).alias("notebook"))


@query(f"""WITH {STEPS}, a AS (SELECT qid, t, unit FROM steps), b AS (SELECT qid, t, doc FROM steps), c AS (SELECT qid, t, role FROM steps), d AS (SELECT qid, t, score FROM steps), e AS (SELECT qid, t, quantity FROM steps), f AS (SELECT qid, t, discount FROM steps)
SELECT role, count(*) AS n, round(sum(score * discount), 2) AS v FROM a JOIN b USING (qid, t) JOIN c USING (qid, t) JOIN d USING (qid, t) JOIN e USING (qid, t) JOIN f USING (qid, t) GROUP BY role""")
def step_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = steps(spark, sf_dir)
    joined = J.six_way([own.select("qid", "t", c) for c in ("unit", "doc", "role", "score", "quantity", "discount")])
    return joined.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("score") * F.col("discount")), 2).alias("v"))


@query(f"""WITH {STEPS}, bank AS (SELECT qid, t AS bt, unit FROM steps WHERE t % 3 = 1), q AS (SELECT qid, t FROM steps WHERE t % 2 = 0),
j AS (SELECT q.qid, q.t, b.bt, b.unit, row_number() OVER (PARTITION BY q.qid, q.t ORDER BY (b.bt <= q.t) DESC, CASE WHEN b.bt <= q.t THEN -b.bt ELSE b.bt END) AS n FROM q LEFT JOIN bank b USING (qid))
SELECT qid, t, bt AS source_t, unit FROM j WHERE n = 1""")
def as_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = steps(spark, sf_dir)
    return J.as_of(own.where("t % 2 = 0").select("qid", "t"), own.where("t % 3 = 1").select("qid", "t", "unit"))


@query("""SELECT o_orderpriority AS part, o_orderkey AS qid, coalesce(lead(o_orderkey) OVER w, first(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)) AS paired
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)""")
def cyclic_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_orderkey").alias("qid"))
    return J.cyclic_next(rows, "qid", "part")


@query("""SELECT o_orderkey AS qid, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unmatched(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid")), ["qid"])


@query("""SELECT p_brand AS brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand""")
def registry_semi_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.units import provenance

    lines = table(spark, sf_dir, "lineitem")
    allowed = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    used = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    kept = lines.join(allowed, "l_orderkey", "left_semi").join(used, "l_suppkey", "left_anti").withColumnRenamed("l_partkey", "unit_id")
    named = provenance(kept, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("brand")))
    return named.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"""WITH {STEPS}, p AS (SELECT role, t, score, lag(score) OVER {W_STEP} AS b FROM steps)
SELECT role, sum(CASE WHEN score > b THEN 1 ELSE 0 END)::BIGINT AS wins, sum(CASE WHEN score = b THEN 1 ELSE 0 END)::BIGINT AS ties, sum(CASE WHEN score < b THEN 1 ELSE 0 END)::BIGINT AS losses FROM p WHERE b IS NOT NULL GROUP BY role""")
def win_tie_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = J.neighbours(steps(spark, sf_dir), "score").where("previous_score is not null")
    count = lambda c: F.sum(c.cast("int"))
    a, b = F.col("score"), F.col("previous_score")
    return pairs.groupBy("role").agg(count(a > b).alias("wins"), count(a == b).alias("ties"), count(a < b).alias("losses"))


@query(f"""WITH {STEPS}, r AS (SELECT qid, t, (row_number() OVER (PARTITION BY qid, doc ORDER BY t) > 1)::INTEGER AS again FROM steps)
SELECT t, count(*) AS steps, sum(again)::BIGINT AS again, round(sum(again) / count(*), 6) AS rate FROM r GROUP BY t""")
def reselection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = (F.row_number().over(Window.partitionBy("qid", "doc").orderBy("t")) > 1).cast("int")
    return steps(spark, sf_dir).withColumn("again", again).groupBy("t").agg(F.count(F.lit(1)).alias("steps"), F.sum("again").alias("again"), F.round(F.sum("again") / F.count(F.lit(1)), 6).alias("rate"))


@query(f"""WITH {STEPS}, x AS (SELECT *, CASE WHEN t >= 1 THEN 2 ELSE 1 END AS times FROM steps WHERE quantity > 25)
SELECT qid, t, unit, r AS repetition FROM x, generate_series(0, 1) g(r) WHERE r < times""")
def oversampled_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = steps(spark, sf_dir).where("quantity > 25")
    return J.repeat(hard, F.when(F.col("t") >= 1, 2).otherwise(1)).select("qid", "t", "unit", F.col("repetition").cast("long").alias("repetition"))


@query(f"""WITH {STEPS}, c AS (SELECT qid, list(unit ORDER BY t) AS candidates, min_by(unit, t) AS positive FROM steps GROUP BY qid)
SELECT qid, i - 1 AS pos, candidates[i] AS unit, (candidates[i] = positive)::INTEGER AS label FROM c, generate_series(1, 20) g(i) WHERE i <= len(candidates)""")
def flattened_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = steps(spark, sf_dir).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "unit"))), lambda x: x["unit"]).alias("candidates"), F.min_by("unit", "t").alias("positive"))
    return scorers.flatten(lists.withColumn("t", F.lit(0))).select("qid", F.col("pos").cast("long").alias("pos"), "unit", "label")


@query(f"""WITH {STEPS}, s AS (SELECT qid, discount * 10 AS score, (t = 0)::INTEGER AS label FROM steps), p AS (SELECT *, max(CASE WHEN label = 1 THEN score END) OVER (PARTITION BY qid) AS p, max(score) OVER (PARTITION BY qid) AS m FROM s)
SELECT qid, round(ln(sum(exp(score - m))) + max(m) - max(p), 6) AS ce, round(avg(CASE WHEN label = 0 THEN greatest(0.0::DOUBLE, 0.2 - p + score) END), 6) AS hinge FROM p GROUP BY qid""")
def ranking_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = steps(spark, sf_dir).select("qid", (F.col("discount") * 10).alias("score"), (F.col("t") == 0).cast("int").alias("label"))
    return scorers.losses(scored)


@query(f"""WITH {STEPS}, r AS (SELECT qid, t, score, quantity, min(score) OVER w AS a, max(score) OVER w AS b, min(quantity) OVER w AS c, max(quantity) OVER w AS d FROM steps WINDOW w AS (PARTITION BY qid))
SELECT qid, t, round(0.35 * CASE WHEN b - a < 1e-12 THEN 0 ELSE (score - a) / (b - a) END + (1 - 0.35) * CASE WHEN d - c < 1e-12 THEN 0 ELSE (quantity - c) / (d - c) END, 6) AS policy_score FROM r""")
def blended_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = steps(spark, sf_dir).withColumnRenamed("quantity", "front")
    return scorers.policy(own, "blend", 0.35).select("qid", "t", "policy_score")


@query(f"""WITH {STEPS}, o AS (SELECT qid, t, discount, quantity, lag(t) OVER {W_STEP} AS b, count(*) OVER (PARTITION BY qid, unit) AS n FROM steps),
i AS (SELECT qid, t, unnest([CASE WHEN discount > 0.09 THEN 'high_discount' END, CASE WHEN quantity < 2 THEN 'tiny' END, CASE WHEN n > 1 THEN 'repeated_unit' END]) AS code FROM o)
SELECT code, CASE WHEN code = 'repeated_unit' THEN 'CRITICAL' ELSE 'WARNING' END AS severity, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY code""")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = steps(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid", "unit")))
    rules = {"high_discount": ("WARNING", F.col("discount") > 0.09), "tiny": ("WARNING", F.col("quantity") < 2), "repeated_unit": ("CRITICAL", F.col("n") > 1)}
    return statistics.issues(counted, ["qid", "t"], rules).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STEPS}, c AS (SELECT qid, sha256(array_to_string(list(unit ORDER BY t), chr(10))) AS context_key FROM steps GROUP BY qid) SELECT context_key, count(*) AS questions, min(qid) AS first_qid FROM c GROUP BY context_key""")
def context_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "unit"))), lambda x: x["unit"].cast("string"))
    keys = steps(spark, sf_dir).groupBy("qid").agg(statistics.ordered_digest(ordered).alias("context_key"))
    return keys.groupBy("context_key").agg(F.count(F.lit(1)).alias("questions"), F.min("qid").alias("first_qid"))


@query()
def teacher_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy trajectories; a fold over mutable state, tested against a plain version."""
    own = J.keep_first(steps(spark, sf_dir), ["qid", "unit"], ["t"])
    return teacher.rollout(own.select("qid", "unit", "role", F.lit(1.0).alias("weight"), (F.col("score") / 100000).alias("score"), "doc"))


@query(f"""WITH {STEPS}, s AS (SELECT qid, max(CASE WHEN role = 'bridge' THEN discount END) * 10 AS b, max(CASE WHEN role = 'support' THEN discount END) * 10 AS s, max(quantity) AS q FROM steps GROUP BY qid),
v AS (SELECT qid, list_filter([b, s], lambda x: x IS NOT NULL) AS scores, q > 40 AS note, q > 48 AS failed FROM s)
SELECT qid, len(list_filter(scores, lambda x: x < 0.7)) = 0 AS complete, len(list_filter(scores, lambda x: x < 0.7)) = 0 AND NOT note AND NOT failed AS stop FROM v""")
def stop_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda r: F.max(F.when(F.col("role") == r, F.col("discount"))) * 10
    rows = steps(spark, sf_dir).groupBy("qid").agg(F.array_compact(F.array(by("bridge"), by("support"))).alias("scores"), F.max("quantity").alias("q"))
    return rows.select("qid", teacher.raw_complete(F.col("scores")).alias("complete"), teacher.cheap_stop(F.col("scores"), F.col("q") > 40, F.col("q") > 48).alias("stop"))
