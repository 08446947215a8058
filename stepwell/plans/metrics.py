"""Queries over answers and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import statistics as S
from ..streaming import state
from .registry import STEPS, query, steps, table


@query("""WITH d AS (SELECT doc_id, lang, source, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, quality, count(*) AS n FROM d GROUP BY CUBE (lang, quality)""")
def group_counts_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.withColumn("quality", F.coalesce("quality", F.lit(-1))).cube("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STEPS} SELECT qid, sum(CASE WHEN role = 'bridge' THEN quantity END) AS bridge, sum(CASE WHEN role = 'distinguish' THEN quantity END) AS distinguish, sum(CASE WHEN role = 'support' THEN quantity END) AS support FROM steps GROUP BY qid")
def role_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("qid").pivot("role", ["bridge", "distinguish", "support"]).agg(F.sum("quantity"))


_RANKED = f"{STEPS}, r AS (SELECT qid, role, unit, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM steps), g AS (SELECT qid, min(rank) FILTER (role = 'support') AS pr, count(*) AS n, count(DISTINCT unit) FILTER (role = 'support') AS gold FROM r GROUP BY qid)"


@query(f"""WITH {_RANKED} SELECT count(*) AS questions, {", ".join(f"round(avg(CASE WHEN pr <= {k} THEN 1.0 ELSE 0 END), 6) AS acc_{k}" for k in (1, 2, 3, 5))}, round(avg(1.0 / pr), 6) AS mrr, round(sum(gold) / greatest(sum(n), 1), 6) AS gold_share FROM g""")
def step_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.col("role") == "support"
    ranked = steps(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "unit")))
    each = ranked.groupBy("qid").agg(F.min(F.when(gold, F.col("rank"))).alias("pr"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(gold, F.col("unit"))).alias("gold"))
    acc = [F.round(F.avg(F.when(F.col("pr") <= k, 1.0).otherwise(0.0)), 6).alias(f"acc_{k}") for k in (1, 2, 3, 5)]
    return each.agg(F.count(F.lit(1)).alias("questions"), *acc, F.round(F.avg(1.0 / F.col("pr")), 6).alias("mrr"), S.ratio_of_sums("gold", "n").alias("gold_share"))


_SETS = f"""{STEPS}, s AS (SELECT qid, coalesce(list(DISTINCT unit) FILTER (quantity > 15), []) AS p, coalesce(list(DISTINCT unit) FILTER (role = 'support'), []) AS g FROM steps GROUP BY qid),
m AS (SELECT qid, len(p) AS np, len(g) AS ng, len(list_intersect(p, g)) AS tp FROM s),
e AS (SELECT qid, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN ng > 0 THEN tp / ng ELSE 0 END AS recall, (tp = np AND tp = ng)::INTEGER AS em, (tp = ng)::INTEGER AS full_coverage FROM m)"""


@query(f"WITH {_SETS} SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, em, full_coverage FROM e")
def evidence_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = steps(spark, sf_dir).groupBy("qid").agg(F.collect_set(F.when(F.col("quantity") > 15, F.col("unit"))).alias("p"), F.collect_set(F.when(F.col("role") == "support", F.col("unit"))).alias("g"))
    m = A.set_metrics(F.col("p"), F.col("g"))
    return sets.select("qid", *[(c if n in ("em", "full_coverage") else F.round(c, 6)).alias(n) for n, c in m.items()])


@query(f"""WITH {_SETS} SELECT qid, round(precision * precision, 6) AS precision, round(recall * recall, 6) AS recall, round(CASE WHEN precision * precision + recall * recall > 0 THEN 2 * precision * precision * recall * recall / (precision * precision + recall * recall) ELSE 0 END, 6) AS f1, em * em AS em FROM e""")
def joint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = steps(spark, sf_dir).groupBy("qid").agg(F.collect_set(F.when(F.col("quantity") > 15, F.col("unit"))).alias("p"), F.collect_set(F.when(F.col("role") == "support", F.col("unit"))).alias("g"))
    m = A.set_metrics(F.col("p"), F.col("g"))
    return sets.select("qid", *[(c if n == "em" else F.round(c, 6)).alias(n) for n, c in A.joint(m, m).items()])


_ANSWERS = r"""c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations), p AS (SELECT conv_id, turn, text, gold FROM c WHERE gold IS NOT NULL),
n AS (SELECT conv_id, turn, list_filter(string_split_regex(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS a,
 list_filter(string_split_regex(translate(lower(gold), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS b FROM p),
o AS (SELECT conv_id, turn, a, b, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS same FROM n)"""


@query(f"""WITH {_ANSWERS} SELECT conv_id, turn, (array_to_string(a, ' ') = array_to_string(b, ' '))::INTEGER AS em, (len(b) > 0 AND contains(array_to_string(a, ' '), array_to_string(b, ' ')))::INTEGER AS contains,
 round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN (len(a) = 0 AND len(b) = 0)::INTEGER WHEN same = 0 THEN 0 ELSE 2.0 * same / (len(a) + len(b)) END, 6) AS f1 FROM o""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns as prediction and reference. Articles stand alone only: no word of the table holds one behind a letter boundary that SQL sees otherwise."""
    turns = table(spark, sf_dir, "conversations").withColumn("gold", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("gold is not null")
    p, g = F.col("text"), F.col("gold")
    split = turns.select("conv_id", "turn", A.exact_match(p, g).alias("em"), A.contains(p, g).alias("contains"), A.answer_tokens(p).alias("p"), A.answer_tokens(g).alias("g"))
    counted = split.withColumn("same", A.multiset_overlap(F.col("p"), F.col("g")))
    return counted.select("conv_id", "turn", "em", "contains", F.round(A.f1_from(F.col("same"), F.size("p"), F.size("g")), 6).alias("f1"))


@query(f"""WITH {STEPS}, e AS (SELECT role, t, abs(discount - 0.05) AS e, power(discount - 0.05, 2) AS s, unnest(CASE WHEN t >= 1 THEN ['all', 't>=1', role] ELSE ['all', role] END) AS slice FROM steps)
SELECT slice, count(*) AS n, round(avg(e), 6) AS mae, round(avg(s), 6) AS mse FROM e GROUP BY slice""")
def sliced_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.col("t") >= 1, "t>=1"), F.col("role")))
    e = F.col("discount") - 0.05
    return S.sliced(steps(spark, sf_dir), slices, F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e * e), 6).alias("mse"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(corr(value, user_id), 6) AS pearson, round(quantile_cont(value, 0.025), 6) AS p025, round(quantile_cont(value, 0.975), 6) AS p975, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), S.pearson("value", "user_id").alias("pearson"),
        S.percentile("value", 0.025).alias("p025"), S.percentile("value", 0.975).alias("p975"), F.countDistinct("user_id").alias("users"),
    )


@query(f"""WITH {STEPS}, a AS (SELECT qid, first(unit ORDER BY score DESC, t) AS x, first(unit ORDER BY quantity * 1000000 + score DESC, t) AS y, first(role ORDER BY score DESC, t) AS rx, first(role ORDER BY quantity * 1000000 + score DESC, t) AS ry FROM steps GROUP BY qid)
SELECT count(*) AS n, round(avg((x = y)::INTEGER), 6) AS agreement, sum((rx = 'support' AND ry <> 'support')::INTEGER)::BIGINT AS only_first, sum((rx <> 'support' AND ry = 'support')::INTEGER)::BIGINT AS only_second, sum((rx = 'support' AND ry = 'support')::INTEGER)::BIGINT AS both FROM a""")
def teacher_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (F.struct(c, -F.col("t")) for c in (F.col("score"), F.col("quantity") * 1000000 + F.col("score")))  # the first step of those that tie
    picks = steps(spark, sf_dir).groupBy("qid").agg(F.max_by("unit", first).alias("x"), F.max_by("unit", second).alias("y"), F.max_by("role", first).alias("rx"), F.max_by("role", second).alias("ry"))
    hit = lambda c: F.sum(c.cast("int"))
    rx, ry = F.col("rx") == "support", F.col("ry") == "support"
    return picks.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("agreement"), hit(rx & ~ry).alias("only_first"), hit(~rx & ry).alias("only_second"), hit(rx & ry).alias("both"))


@query(f"""WITH {STEPS}, s AS (SELECT qid, max(discount) > min(discount) AS moved, bool_or(role = 'support' AND quantity > 30) AS derived, bool_or(quantity > 49) AS success FROM steps GROUP BY qid)
SELECT CASE WHEN success THEN 'success' WHEN moved OR derived THEN 'failed_but_progressive' ELSE 'failed_stalled' END AS status, count(*) AS n FROM s GROUP BY status""")
def trajectory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.trajectories import status

    signals = steps(spark, sf_dir).groupBy("qid").agg((F.max("discount") > F.min("discount")).alias("moved"), F.bool_or((F.col("role") == "support") & (F.col("quantity") > 30)).alias("derived"), F.bool_or(F.col("quantity") > 49).alias("success"))
    return signals.select(status(F.col("success"), F.col("moved") | F.col("derived")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_DRAW = "(" + " + ".join(f"(u >= {sum(0.36787944117144233 / __import__('math').factorial(i) for i in range(k + 1))!r})::INTEGER" for k in range(7)) + ")"


@query(f"""WITH {STEPS}, r AS (SELECT qid, sum(CASE WHEN role = 'support' THEN 1 ELSE 0 END) AS num, count(*) AS den FROM steps GROUP BY qid),
d AS (SELECT b, num, den, ('0x' || substr(md5('3::' || b // 4 || '::' || qid), 8 * (b % 4) + 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM r, generate_series(0, 99) g(b)), n AS (SELECT b, num, den, {_DRAW} AS k FROM d),
v AS (SELECT b, sum(num * k) / greatest(sum(den * k), 1) AS v FROM n GROUP BY b) SELECT (SELECT round(sum(num) / greatest(sum(den), 1), 6) FROM r) AS observed, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM v""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).groupBy("qid").agg(F.sum((F.col("role") == "support").cast("int")).alias("num"), F.count(F.lit(1)).alias("den"))
    return S.bootstrap(rows, "qid", "num", "den", 100, 3)


@query(f"""WITH {STEPS}, r AS (SELECT qid, max(CASE WHEN t = 0 THEN discount END) AS a, max(CASE WHEN t = 1 THEN discount END) AS b FROM steps GROUP BY qid HAVING count(*) > 1),
d AS (SELECT k.b AS rep, r.b - r.a AS x, ('0x' || substr(md5('4::' || k.b // 4 || '::' || qid), 8 * (k.b % 4) + 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM r, generate_series(0, 99) k(b)), n AS (SELECT rep, x, {_DRAW} AS k FROM d),
v AS (SELECT rep, sum(x * k) / greatest(sum(k), 1) AS v FROM n GROUP BY rep), o AS (SELECT (SELECT round(avg(b - a), 6) FROM r) AS observed, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM v)
SELECT *, CASE WHEN ci_low > 0 THEN 'primary_higher' WHEN ci_high < 0 THEN 'primary_lower' ELSE 'interval_includes_zero' END AS significance FROM o""")
def paired_bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: F.max(F.when(F.col("t") == k, F.col("discount")))
    rows = steps(spark, sf_dir).groupBy("qid").agg(pick(0).alias("a"), pick(1).alias("b")).where("b is not null")
    return S.paired_bootstrap(rows, "qid", "a", "b", 100, 4).withColumn("significance", S.significance(F.col("ci_low"), F.col("ci_high")))


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL""")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))


@query("""WITH s AS (SELECT user_id AS qid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, props) - 1 AS t, event_type AS unit, props AS doc FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY qid, unit ORDER BY t) AS times, min(t) OVER (PARTITION BY qid, unit) AS added_step, row_number() OVER (PARTITION BY qid, doc ORDER BY t) AS d FROM s)
SELECT qid, t, unit, added_step, times, count(*) FILTER (times = 1) OVER w AS distinct_units, count(*) FILTER (d = 1) OVER w AS distinct_docs FROM m WINDOW w AS (PARTITION BY qid ORDER BY t)""")
def replayed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every event makes of its user's ledger of event types and properties."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("ts").alias("at"), F.col("event_type").alias("unit"), F.col("props").alias("doc"))
    return state.replay(rows)


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts) + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS closes, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, which end half an hour after their last event."""
    rows, at = state.sessions(table(spark, sf_dir, "events")), "yyyy-MM-dd HH:mm:ss"
    return rows.select("user_id", F.date_format("window.start", at).alias("first"), F.date_format("window.end", at).alias("closes"), "n", "value")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 20 MINUTES, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 20 MINUTES AS start, event_type, value FROM events, range(0, 3) r(k))
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM w GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that start every twenty minutes."""
    return state.sliding(table(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "value")
