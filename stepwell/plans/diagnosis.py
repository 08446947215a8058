"""Queries over audits of runs: causes, interventions, agreement, costs, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diagnostics as D
from ..operators import gates as G
from ..operators import retrieval as R
from ..operators import trajectories as J
from .registry import STEPS, query, steps, table


@query(f"""WITH {STEPS}, s AS (SELECT qid, count(*) AS n, max(discount) > 0.05 AS em, min(quantity) > 3 AS covered FROM steps GROUP BY qid) SELECT qid, {', '.join(f"(em AND covered AND n <= {b})::INTEGER AS success_{b}" for b in (2, 4, 8))} FROM s""")
def closure_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = steps(spark, sf_dir).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), (F.max("discount") > 0.05).cast("int").alias("em"), (F.min("quantity") > 3).alias("covered"))
    return per.select("qid", *(c.alias(n) for n, c in D.closure_success(F.col("em"), F.col("covered"), F.col("n"), [2, 4, 8]).items()))


@query(f"""WITH {STEPS}, s AS (SELECT qid, list_distinct(list(doc % 6) FILTER (t <= 2)) AS p, list_distinct(list(doc % 6) FILTER (t >= 1)) AS g FROM steps GROUP BY qid), h AS (SELECT qid, len(p) AS np, coalesce(len(g), 0) AS ng, coalesce(len(list_intersect(p, g)), 0) AS h FROM s),
m AS (SELECT *, h / np AS pr, CASE WHEN ng > 0 THEN h / ng ELSE 0 END AS re FROM h) SELECT qid, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, (np = ng AND h = ng)::INTEGER::DOUBLE AS em, (h = ng)::INTEGER::DOUBLE AS coverage FROM m""")
def title_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = (F.col("doc") % 6).cast("string")
    per = steps(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.when(F.col("t") <= 2, title)).alias("p"), F.collect_list(F.when(F.col("t") >= 1, title)).alias("g"))
    return per.select("qid", *(F.round(c, 6).alias(n) for n, c in D.title_metrics(F.col("p"), F.col("g")).items()))


@query(f"""WITH {STEPS} SELECT qid, sum(CASE WHEN discount > 0.05 THEN (unit % 9 + 1 <= 3)::INTEGER ELSE (t % 5 < 3 AND quantity > 10)::INTEGER END)::BIGINT AS hits, count(*) AS steps FROM steps GROUP BY qid""")
def alignment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.col("quantity") > 10, F.array(*(F.lit(i).cast("long") for i in range(5))))
    rows = steps(spark, sf_dir).select("qid", F.when(F.col("discount") > 0.05, F.col("unit") % 9 + 1).alias("rank"), listed.alias("selected"), (F.col("t") % 5).alias("positive"))
    return D.alignment_at(rows, 3)


@query(f"""WITH {STEPS}, x AS (SELECT doc_id AS unit, coalesce(text, '') AS text FROM documents), s AS (SELECT DISTINCT qid, unit FROM steps), p AS (SELECT qid, count(*) AS u, sum(length(text)) + count(*) - 1 AS c, sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) AS k FROM s JOIN x USING (unit) GROUP BY qid)
SELECT round(avg(u), 6) AS mean_units, round(avg(c), 6) AS mean_chars, round(avg(k), 6) AS mean_tokens, count(*) AS contexts FROM p""")
def context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.coalesce("text", F.lit("")).alias("text"))
    return D.context_sizes(steps(spark, sf_dir).select("qid", "unit").distinct(), units)


_BOOKS = f"""{STEPS}, b AS (SELECT qid, t, unit, 'Evidence:' || chr(10) || string_agg('u' || unit, chr(10)) OVER w AS book, list('u' || unit) OVER w AS lines FROM steps WINDOW w AS (PARTITION BY qid ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
m AS (SELECT qid, t, string_agg(lines[i], chr(10) ORDER BY sha256('5::' || qid || '::' || t || '::' || (i - 1))) AS mixed FROM b, generate_series(1, 3) g(i) WHERE i <= len(lines) GROUP BY qid, t)"""


@query(f"""WITH {_BOOKS}, f AS (SELECT b.*, first_value(book) OVER (PARTITION BY qid ORDER BY t) AS frozen, CASE WHEN len(lines) <= 1 THEN book ELSE 'Evidence:' || chr(10) || mixed END AS shuffled FROM b JOIN m USING (qid, t)),
v AS (SELECT qid, t, unnest(['correct', 'query_only', 'empty', 'frozen', 'shuffled', 'other_question', 'previous_evidence_only']) AS condition, unnest([book, NULL, '', frozen, shuffled, CASE WHEN t % 2 = 0 THEN 'o' ELSE '' END, '']) AS book FROM f)
SELECT qid, t, condition, CASE WHEN book IS NULL THEN 'q' || qid WHEN book = '' THEN 'Question: q' || qid ELSE 'Question: q' || qid || chr(10) || 'Notebook:' || chr(10) || book END AS context FROM v""")
def context_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = J.step_window().rowsBetween(-2, 0)
    book = F.concat(F.lit("Evidence:\n"), F.array_join(F.collect_list(F.concat(F.lit("u"), F.col("unit").cast("string"))).over(w), "\n"))
    rows = steps(spark, sf_dir).select("qid", "t", F.concat(F.lit("q"), F.col("qid").cast("string")).alias("question"), book.alias("notebook"), F.when(F.col("t") % 2 == 0, "o").alias("other"), F.lit(None).cast("string").alias("previous"))
    return D.interventions(rows, 5)


@query(f"""WITH {STEPS}, s AS (SELECT t, 1 + unit % 9 AS c, CASE WHEN discount > 0.01 THEN 1 + doc % 9 END AS q FROM steps), e AS (SELECT * FROM s WHERE t >= 1 AND q IS NOT NULL)
SELECT count(*) AS eligible, {', '.join(f"count(*) FILTER (c <= {k} AND q > {k}) AS rescued_at_{k}, count(*) FILTER (c > {k} AND q <= {k}) AS harmed_at_{k}" for k in (1, 5))}, count(*) FILTER (c < q) AS rank_improved, count(*) FILTER (c > q) AS rank_degraded, round(avg(q - c), 6) AS mean_gain FROM e""")
def state_necessity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.state_necessity(steps(spark, sf_dir).select("t", (1 + F.col("unit") % 9).alias("correct"), F.when(F.col("discount") > 0.01, 1 + F.col("doc") % 9).alias("query")))


@query(f"""WITH {STEPS}, l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t DESC) AS r FROM steps), a AS (SELECT qid, max(quantity) > 20 AS progressed, bool_and(discount <= 0.06) AS plateau, bool_or(quantity >= 30) AS rep, count(DISTINCT doc % 2) < count(*) AS same, bool_or(role = 'bridge') AS need, bool_or(role = 'support') AS trig, bool_or(unit % 7 = 0) AS stop, qid % 2 AS probes, (qid % 10) / 10 AS cov FROM l WHERE r <= 2 GROUP BY qid)
SELECT qid, CASE WHEN NOT progressed THEN 'stalled_without_progress' WHEN plateau AND rep AND same THEN 'stalled_retrieval_looping' WHEN plateau AND probes = 0 AND NOT stop AND cov >= 0.8 THEN 'stalled_stop_gate_too_conservative' WHEN plateau AND probes = 0 AND NOT stop AND NOT need THEN 'stalled_need_derived_not_opened' WHEN plateau AND trig THEN 'stalled_need_derived_opened_but_no_effect' ELSE 'stalled_after_progress' END AS cause FROM a""")
def stall_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.col("l")
    fields = F.struct((-F.col("t")).alias("r"), "quantity", "discount", "doc", "role", "unit")
    per = steps(spark, sf_dir).groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(fields)), 1, 2).alias("l"))
    each = lambda f: F.transform(last, f)
    cause = D.stall_cause(
        F.exists(last, lambda x: x["quantity"] > 20), each(lambda x: (x["discount"] > 0.06).cast("int")), each(lambda x: F.when(x["quantity"] >= 30, 0.9).otherwise(0.1)), each(lambda x: x["doc"] % 2), each(lambda x: x["role"] == "bridge"),
        each(lambda x: x["role"] == "support"), each(lambda x: x["unit"] % 7 == 0), F.col("qid") % 2, (F.col("qid") % 10) / 10,
    )
    return per.select("qid", cause.alias("cause"))


@query(f"""WITH {STEPS}, a AS (SELECT role, discount > 0.05 AS ng, discount > 0.07 AS sg, quantity > 25 AS novel, unit % 2 = 0 AS pool, unit % 3 > 0 AS raw, doc % 3 AS delta FROM steps)
SELECT CASE WHEN role = 'distinguish' AND ng AND NOT sg THEN 'answer_facing_verification' WHEN role = 'distinguish' AND novel THEN 'abstractive_verification' WHEN role = 'distinguish' THEN 'verification_without_new_surface_signal' WHEN role = 'bridge' AND raw AND NOT pool THEN 'bridge_scaffold_for_new_raw'
 WHEN role = 'bridge' AND raw AND delta > 0 THEN 'bridge_scaffold_for_progress' WHEN role = 'bridge' THEN 'bridge_contextualization' ELSE 'unknown' END AS note_role, count(*) AS n FROM a GROUP BY ALL""")
def note_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "distinguish", "verification_note").when(F.col("role") == "bridge", "bridge_note").otherwise("other")
    novel = F.when(F.col("quantity") > 25, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    role = D.note_role(kind, F.col("discount") > 0.05, F.col("discount") > 0.07, novel, F.col("unit") % 2 == 0, F.col("unit") % 3 > 0, F.col("doc") % 3)
    return steps(spark, sf_dir).groupBy(role.alias("note_role")).agg(F.count(F.lit(1)).alias("n"))


_FLAGS = {"considered": "unit % 3 > 0", "selected": "unit % 5 > 2", "dropped": "doc % 9 = 0", "continued": "doc % 2 = 0", "kept_options": "doc % 3 = 0"}
_COUNTS = {"harvested": "quantity > 5", "legal": "quantity > 10", "retained": "quantity > 20", "delta": "quantity > 48"}


@query(f"""WITH {STEPS}, c AS (SELECT DISTINCT qid, CASE qid % 3 WHEN 0 THEN 'stop_gate_too_conservative' WHEN 1 THEN 'answer_wrong_after_sufficient_evidence' ELSE 'other' END AS failure FROM steps), a AS (SELECT qid, {', '.join(f"bool_or({e}) AS {n}" for n, e in {**_FLAGS, **_COUNTS}.items())} FROM steps WHERE discount > 0.06 GROUP BY qid)
SELECT c.qid, CASE WHEN legal IS NULL AND failure = 'stop_gate_too_conservative' THEN 'stop_gate_not_reopened' WHEN legal IS NULL AND failure = 'answer_wrong_after_sufficient_evidence' THEN 'answer_focus_not_fixed' WHEN legal IS NULL THEN 'no_repair_attempt' WHEN NOT harvested OR NOT legal THEN 'repair_note_low_closure_value'
 WHEN NOT retained THEN 'repair_note_good_but_not_retained' WHEN NOT considered THEN 'repair_note_retained_but_not_used' WHEN dropped THEN 'repair_linked_candidate_dropped_from_pool' WHEN NOT selected THEN 'teacher_select_not_using_repair' WHEN continued AND kept_options AND NOT delta THEN 'closure_continuation_not_catching_answer_hop'
 WHEN NOT delta THEN 'repair_note_selected_but_no_closure_gain' ELSE 'repair_note_low_closure_value' END AS bottleneck FROM c LEFT JOIN a USING (qid)""")
def repair_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    failure = F.when(F.col("qid") % 3 == 0, "stop_gate_too_conservative").when(F.col("qid") % 3 == 1, "answer_wrong_after_sufficient_evidence").otherwise("other")
    attempts = rows.where("discount > 0.06").select("qid", *(F.expr(f"cast({e} as int)").alias(n) for n, e in _COUNTS.items()), *(F.expr(e).alias(n) for n, e in _FLAGS.items()))
    return D.repair_bottlenecks(rows.select("qid", failure.alias("failure")).distinct(), attempts)


@query(f"""WITH {STEPS}, p AS (SELECT *, lag(unit % 2) OVER (PARTITION BY qid ORDER BY t) IS NOT DISTINCT FROM doc % 2 AS gold FROM steps), s AS (SELECT gold AS anchor_gold, count(*) AS states, round(avg((1 + quantity::INTEGER % 9 = 1)::INTEGER), 6) AS step_at_1, round(avg((1 + quantity::INTEGER % 9 <= 5)::INTEGER), 6) AS step_at_5, round(avg(1 / (1 + quantity::INTEGER % 9)), 6) AS mrr FROM p WHERE t >= 1 GROUP BY gold)
SELECT *, round(states / sum(states) OVER (), 6) AS share FROM s""")
def anchor_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).select("qid", "t", (F.col("doc") % 2).alias("anchor"), (F.col("unit") % 2).alias("positive"), (1 + F.col("quantity").cast("int") % 9).alias("rank"))
    return D.anchor_conditioning(rows)


@query(f"""WITH {STEPS}, s AS (SELECT qid, min(discount) - 0.02 AS a, min(quantity) - 20 AS b, max(discount) - 0.06 AS c FROM steps GROUP BY qid) SELECT ((a > 0 OR b > 0) AND c >= 0) AS passes, count(*) AS n FROM s GROUP BY ALL""")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = steps(spark, sf_dir).groupBy("qid").agg((F.min("discount") - 0.02).alias("a"), (F.min("quantity") - 20).alias("b"), (F.max("discount") - 0.06).alias("c"))
    return per.groupBy(D.gate_passes(F.col("a"), F.col("b"), F.col("c")).alias("passes")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STEPS}, s AS (SELECT qid, t, role, CASE WHEN t = 0 THEN (unit % 10 = 0)::INTEGER::DOUBLE ELSE lag(discount) OVER w END AS b, discount AS a, lag(discount) OVER w AS p, first_value(role) OVER w AS q FROM steps WINDOW w AS (PARTITION BY qid ORDER BY t))
SELECT qid, t, 'coverage_falls' AS reason FROM s WHERE a < b UNION ALL SELECT qid, t, 'question_changes' FROM s WHERE role <> q UNION ALL SELECT qid, t, 'start_not_empty' FROM s WHERE t = 0 AND b > 0""")
def clue_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.when(F.col("t") == 0, (F.col("unit") % 10 == 0).cast("double")).otherwise(F.lag("discount").over(J.step_window()))
    rows = steps(spark, sf_dir).select("qid", "t", F.col("role").alias("question"), F.array(before).alias("before"), F.array("discount").alias("after"))
    return D.clue_breaks(rows)


@query(f"""WITH {STEPS} SELECT qid, count(*) AS calls, sum(CASE WHEN discount > 0.02 THEN quantity::BIGINT ELSE 0 END)::BIGINT AS tokens, round(sum(discount), 6) AS seconds, count(*) FILTER (role = 'bridge') AS empty_outputs FROM steps GROUP BY qid""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = steps(spark, sf_dir).select("qid", F.when(F.col("discount") > 0.02, F.col("quantity").cast("long")).alias("tokens"), F.col("discount").alias("seconds"), F.when(F.col("role") == "bridge", " ").otherwise(F.col("role")).alias("output"))
    return D.costs(calls)


@query(f"""WITH {STEPS}, s AS (SELECT qid, min(t) FILTER (t = qid % 3) AS own, arg_min(t, t - score * 1000) AS b, arg_min(t, t - quantity * 1000) AS r, arg_min(t, t - discount * 100000) AS c FROM steps GROUP BY qid) SELECT count(*) AS states, round(avg((b = own)::INTEGER), 6) AS base, round(avg((r = own)::INTEGER), 6) AS relevance, round(avg((c = own)::INTEGER), 6) AS coverage FROM s WHERE own IS NOT NULL""")
def proxy_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).select("qid", F.lit(0).alias("t"), F.col("t").alias("unit"), (F.col("t") == F.col("qid") % 3).alias("chosen"), F.col("score").alias("base"), F.col("quantity").alias("relevance"), F.col("discount").alias("coverage"))
    return D.proxy_agreement(rows)


@query(f"""WITH {STEPS}, d AS (SELECT qid, t, discount AS deficit FROM steps WHERE quantity > 20) SELECT qid, t, unit, deficit FROM steps LEFT JOIN d USING (qid, t)""")
def teacher_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    return D.teacher_deficits(rows.select("qid", "t", "unit"), rows.where("quantity > 20").withColumnRenamed("discount", "deficit"))


@query(f"""WITH {STEPS}, e AS (SELECT qid, CASE WHEN max(discount) < 0.08 THEN 'failed_stalled' ELSE 'success' END AS status, max(t) + qid % 2 AS terminal, max(t) FILTER (quantity > 25) AS progress FROM steps GROUP BY qid),
k AS (SELECT qid, t FROM steps JOIN e USING (qid) WHERE coalesce(CASE WHEN discount = 0.01 THEN false END, status <> 'failed_stalled' OR progress IS NULL OR t <= progress)) SELECT qid, t, false AS terminal FROM k UNION ALL (SELECT qid, terminal, true FROM e WHERE status = 'success' AND NOT EXISTS (SELECT 1 FROM k WHERE k.qid = e.qid AND k.t = e.terminal))""")
def stop_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    ends = rows.groupBy("qid").agg(F.when(F.max("discount") < 0.08, "failed_stalled").otherwise("success").alias("status"), F.max("t").alias("m"), F.max(F.when(F.col("quantity") > 25, F.col("t"))).alias("last_progress"))
    ends = ends.select("qid", "status", (F.col("m") + F.col("qid") % 2).alias("terminal_step"), "last_progress")
    return D.stop_prefixes(rows.select("qid", "t", F.when(F.col("discount") == 0.01, F.lit(False)).alias("keep")), ends)


@query(f"""WITH {STEPS} SELECT 'run' AS run, role AS stage, round(sum(discount), 6) AS seconds, count(DISTINCT qid) AS qids, round(1000 * sum(discount) / count(DISTINCT qid), 4) AS ms_per_qid FROM steps GROUP BY role""")
def runtime_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).select(F.lit("run").alias("run"), F.col("role").alias("stage"), "qid", F.col("discount").alias("seconds"))
    return D.runtime_profile(rows).select("run", "stage", "seconds", "qids", F.round("ms_per_qid", 4).alias("ms_per_qid"))


@query(f"""WITH {STEPS}, g AS (SELECT qid, max_by(t, quantity * 1000 - t) AS unit FROM steps GROUP BY qid), f AS (SELECT qid, t AS unit, row_number() OVER (PARTITION BY qid ORDER BY score DESC, t) AS a, row_number() OVER (PARTITION BY qid ORDER BY discount DESC, t) AS b FROM steps)
SELECT 'front' AS stage, count(*) FILTER (a <= 2) AS hits, count(*) AS states FROM g JOIN f USING (qid, unit) UNION ALL SELECT 'policy', count(*) FILTER (b <= 2), count(*) FROM g JOIN f USING (qid, unit)""")
def front_end_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).withColumn("unit", F.col("t"))
    gold = rows.groupBy("qid").agg(F.max_by("t", F.col("quantity") * 1000 - F.col("t")).alias("unit"))
    ranked = {n: R.top_k(rows.select("qid", "unit", F.col(c).alias("score")), 1000, unit="unit") for n, c in (("front", "score"), ("policy", "discount"))}
    return D.funnel(gold, ranked, 2)


@query("""WITH o AS (SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey < 20), e AS (SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE n_regionkey::VARCHAR END AS expected FROM nation WHERE n_nationkey >= 3)
SELECT key, expected, value AS observed FROM e FULL JOIN o USING (key) WHERE expected IS NULL OR value IS NULL OR expected <> value""")
def protocol_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    expected = {r.n_name: "x" if r.n_nationkey % 5 == 0 else str(r.n_regionkey) for r in nation.where("n_nationkey >= 3").collect()}  # a run's few settings
    return D.protocol_differences(expected, nation.where("n_nationkey < 20").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")))


@query(f"""WITH {STEPS} SELECT qid, string_agg(lpad(t::VARCHAR, 3, ' ') || ' ' || repeat('#', (quantity::INTEGER) % 20), chr(10) ORDER BY t) AS plot FROM steps GROUP BY qid""")
def trajectory_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.trajectory_marks(steps(spark, sf_dir).select("qid", "t", ((F.col("quantity").cast("int") % 20) / 20).alias("deficit")))


@query(f"""WITH {STEPS}, a AS (SELECT qid, t, CASE WHEN role = 'bridge' THEN 'failed' ELSE ' Stalled ' END AS status, CASE WHEN quantity > 40 THEN 'oscillation' ELSE '' END AS reason, discount FROM steps)
SELECT qid, t, CASE WHEN status = 'failed' THEN '?' ELSE 'failed_stalled' END AS name, status <> 'failed' OR reason = 'oscillation' AS stalled, round(discount * 3 / (3 + 2.0), 6) AS gain, round(((discount > 0.02)::INTEGER + (discount > 0.04)::INTEGER + (discount > 0.06)::INTEGER) / 3.0, 6) AS answerable FROM a""")
def status_and_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, reason = F.when(F.col("role") == "bridge", "failed").otherwise(" Stalled "), F.when(F.col("quantity") > 40, "oscillation").otherwise("")
    d = F.col("discount")
    return steps(spark, sf_dir).select("qid", "t", F.coalesce(G.status_name(status), F.lit("?")).alias("name"), G.is_stalled(status, reason).alias("stalled"), F.round(G.role_gain(F.lit(0.0), d * 3, F.lit(3)), 6).alias("gain"), F.round(G.context_answerability(d > 0.02, d > 0.04, d > 0.06), 6).alias("answerable"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents) SELECT doc_id, plain FROM c""")
def lexical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", G.lexical(F.coalesce("text", F.lit(""))).alias("plain"))


@query(f"""WITH {STEPS}, w AS (SELECT qid, t, list(role) OVER (PARTITION BY qid ORDER BY t) AS r, avg(discount) OVER (PARTITION BY qid ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS d FROM steps)
SELECT qid, t, list_contains(r[greatest(1, len(r) - 1):len(r)], 'support') AS recent, t >= 1 AND d <= 0.05 + 1e-12 AS stops FROM w""")
def recent_notes_and_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = J.step_window()
    rows = steps(spark, sf_dir).select("qid", "t", F.collect_list("role").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r"), F.collect_list("discount").over(w.rowsBetween(-1, 0)).alias("d"))
    return rows.select("qid", "t", G.recent_note(F.col("r"), "support").alias("recent"), G.deficit_stop(F.col("d"), F.col("t"), 0.05 + 1e-12).alias("stops"))


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE rtrim(left(trim(text), 80)) || ' | ' END || 'need: more' AS summary FROM documents""")
def slot_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", G.slot_summary(F.col("text"), F.lit(""), F.lit("more")).alias("summary"))


@query(f"""WITH {STEPS}, e AS (SELECT qid, list(role) FILTER (discount > 0.07) AS r, bool_or(discount > 0.07 AND t < 2 AND role = 'bridge') AS early FROM steps GROUP BY qid)
SELECT qid, CASE WHEN r IS NULL THEN 'raw_or_stop_closure' WHEN early THEN 'early_bridge_scaffold' WHEN len(list_filter(r, lambda x: x <> 'support')) = 0 THEN 'late_verification_repair' WHEN qid % 2 = 0 THEN 'mixed_with_stop_fallback' ELSE 'mixed_or_unknown' END AS mechanism FROM e""")
def case_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.struct(F.when(F.col("t") < 2, "early").otherwise("late").alias("position"), F.when(F.col("role") == "support", "verification_note").when(F.col("role") == "bridge", "bridge_note").otherwise("other").alias("note_type"))
    per = steps(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.when(F.col("discount") > 0.07, event)).alias("e"))
    return per.select("qid", G.case_mechanism(F.col("e"), F.when(F.col("qid") % 2 == 0, "gold_fallback").otherwise("probe")).alias("mechanism"))


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> ''))) END AS sentences FROM documents""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.sentence_count(F.coalesce("text", F.lit(""))).alias("sentences"))
