"""Queries over online states, selectors, notes and derived training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adapters, datasets, gates, online, selection, support, teacher
from .registry import STEPS, query, steps, table
from .texts import TOK


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""WITH {STEPS}, u AS (SELECT qid, unit, min(t) AS a, count(*) AS c, min_by(doc, t) AS d, min_by(quantity, t) AS q FROM steps GROUP BY qid, unit),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY a DESC) AS i FROM u),
n AS (SELECT qid, count(*) AS units, max(c) AS most, 'Evidence:' || chr(10) || string_agg('[' || i || '] ' || d || ': taken ' || q::INTEGER, chr(10) ORDER BY i) FILTER (i <= 8) AS notebook FROM r GROUP BY qid)
SELECT qid, units, docs, last_unit, last_step, most, notebook FROM n JOIN (SELECT qid, count(DISTINCT doc) AS docs, max_by(unit, t)::VARCHAR AS last_unit, max(t) AS last_step FROM steps GROUP BY qid) USING (qid)""")
def online_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).withColumn("title", F.lit("")).withColumn("text", F.concat(F.lit("taken "), F.col("quantity").cast("int").cast("string")))
    s = F.col("state")
    return online.states(rows).select(
        "qid", F.size(s["H_t"]).cast("long").alias("units"), F.size(s["A_t"]["doc_ids"]).cast("long").alias("docs"), s["S_t"]["last_added_unit_id"].alias("last_unit"), s["S_t"]["last_updated_step"].cast("long").alias("last_step"),
        F.array_max(F.transform(s["S_t"]["raw_refs"], lambda r: r["selected_count"])).cast("long").alias("most"), s["K_t"].alias("notebook"),
    )


@query(f"""WITH {STEPS}, k AS (SELECT qid, t AS unit, score, row_number() OVER (PARTITION BY qid, doc % 3 ORDER BY score DESC, t) - 1 AS n FROM steps),
p AS (SELECT qid, unit, round(score - 5000 * n, 6) AS value, row_number() OVER (PARTITION BY qid ORDER BY round(score - 5000 * n, 9) DESC, unit) - 1 AS t FROM k) SELECT qid, t, unit, value FROM p WHERE t < 3""")
def online_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pick lowers what its document's other units are worth; documents' lists are merged, so a sort says what the fold must give."""
    rows = steps(spark, sf_dir).select("qid", F.col("t").alias("unit"), "score", (F.col("doc") % 3).alias("doc"))
    return online.rollout(rows, 3, online.repeated_doc_policy(5000.0)).select("qid", F.col("t").cast("long").alias("t"), "unit", F.round("value", 6).alias("value"))


_NOTES = f"""{STEPS}, n AS (SELECT qid, t, CASE role WHEN 'bridge' THEN 'bridge_note' WHEN 'distinguish' THEN 'verification_note' ELSE 'other' END AS type, discount > 0.08 AS force, quantity > 30 AS facing,
 discount < 0.02 AS repair, quantity::INTEGER % 2 = 0 AS final, quantity::INTEGER % 5 AS closure FROM steps)"""


@query(f"""WITH {_NOTES}, b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t DESC) AS r FROM n), k AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY force DESC, facing DESC, repair DESC, final DESC, type = 'verification_note' DESC, closure DESC, t DESC) AS i FROM b WHERE r <= 6 AND type <> 'other'),
f AS (SELECT qid, string_agg(t::VARCHAR, ',' ORDER BY i) AS notes FROM k WHERE i <= 2 GROUP BY qid), l AS (SELECT qid, type, max(t) AS t FROM n WHERE type <> 'other' GROUP BY ALL), m AS (SELECT qid, string_agg(t::VARCHAR, ',' ORDER BY type) AS notes FROM l GROUP BY qid)
SELECT DISTINCT steps.qid, coalesce(f.notes, m.notes, '') AS notes FROM steps LEFT JOIN f USING (qid) LEFT JOIN m USING (qid)""")
def active_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "bridge", "bridge_note").when(F.col("role") == "distinguish", "verification_note").otherwise("other")
    note = F.struct(
        F.col("t").alias("added_step"), F.col("t").cast("string").alias("unit_id"), kind.alias("type"), (F.col("discount") > 0.08).alias("force"), (F.col("quantity") > 30).alias("answer_facing"),
        F.when(F.col("discount") < 0.02, "repair_after_false_stop").alias("mode"), F.when(F.col("quantity").cast("int") % 2 == 0, "final").alias("bucket"), (F.col("quantity").cast("int") % 5).alias("closure"),
    )
    rows = steps(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    return rows.select("qid", joined(online.active_notes(F.col("notes"))).alias("notes"))


@query(f"""WITH {STEPS}, c AS (SELECT qid, t, count(*) OVER (PARTITION BY qid) AS n FROM steps), r AS (SELECT qid, t, n, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n >= 2 AND t = 0 THEN 0 ELSE 1 END, t DESC) AS i FROM c)
SELECT qid, 'Evidence:' || chr(10) || string_agg('[' || i || '] text ' || t, chr(10) ORDER BY i) FILTER (i <= 4) || CASE WHEN max(n) >= 2 THEN chr(10) || chr(10) || 'Notes:' || chr(10) || '[bridge] a note' ELSE '' END AS context FROM r GROUP BY qid""")
def teacher_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.struct(F.col("t").cast("string").alias("unit_id"), F.col("t").alias("added_step"), F.concat(F.lit("text "), F.col("t").cast("string")).alias("text"))
    rows = steps(spark, sf_dir).groupBy("qid").agg(F.collect_list(raw).alias("raw"))
    note = F.array(F.struct(F.lit("bridge_note").alias("type"), F.lit("a note").alias("text"), F.array(F.lit("0")).alias("sources")))
    return rows.select("qid", online.teacher_render(F.col("raw"), F.when(F.size("raw") >= 2, note).otherwise(F.slice(note, 1, 0))).alias("context"))


@query(f"""WITH {STEPS}, l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t DESC) AS r, CASE WHEN quantity > 40 THEN NULL WHEN quantity > 20 THEN role ELSE 'yes' END AS answer FROM steps),
s AS (SELECT qid, count(*) AS n, avg(discount) * 10 AS ratio FROM steps GROUP BY qid), p AS (SELECT qid, count(*) FILTER (discount > 0.07) AS f, max(answer) FILTER (r = 1) AS answer, bool_or(quantity > 25) FILTER (r = 1) AS correct FROM l WHERE r <= 2 GROUP BY qid)
SELECT qid, f AS false_stops, answer, correct, n % 2 AS delta, (n % 2 = 0 AND ratio >= 0.6) AS stagnation, coalesce(qid % 2 = 0 AND answer NOT IN ('yes', 'no'), false) AS mismatch FROM p JOIN s USING (qid)""")
def failure_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second question is one of yes or no, which the last answer may miss."""
    answer = F.when(F.col("quantity") > 40, F.lit(None).cast("string")).when(F.col("quantity") > 20, F.col("role")).otherwise("yes")
    probe = F.struct("t", answer.alias("answer"), (F.col("quantity") > 25).alias("correct"), F.lit(True).alias("sufficient"), (F.col("discount") <= 0.07).alias("stop"))
    rows = steps(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(probe)).alias("probes"), (F.count(F.lit(1)) % 2).alias("delta"), (F.avg("discount") * 10).alias("ratio"))
    s = support.failure_signals(F.when(F.col("qid") % 2 == 0, "Is it one?").otherwise("What is it?"), F.col("probes"), F.col("delta"), F.col("ratio"))
    return rows.select("qid", s.alias("s")).select("qid", F.col("s.false_stop_count_recent").cast("long").alias("false_stops"), F.col("s.last_probe_pred_answer").alias("answer"), F.col("s.last_probe_answer_correct").alias("correct"), F.col("s.last_delta_covered_targets").cast("long").alias("delta"), "s.stagnation", F.col("s.answer_focus_mismatch").alias("mismatch"))


@query(f"""WITH {STEPS}, a AS (SELECT qid, t, role, discount, CASE WHEN quantity > 40 THEN '' WHEN quantity > 20 THEN 'bridge' ELSE role END AS answer FROM steps)
SELECT qid, t, CASE WHEN (answer = '' OR answer <> role) AND discount > 0.03 AND discount < 0.08 THEN role ELSE answer END AS answer FROM a""")
def filled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("quantity") > 40, "").when(F.col("quantity") > 20, "bridge").otherwise(F.col("role"))
    read = F.when(F.col("discount") > 0.03, F.concat(F.lit("a note on "), F.col("role"))).otherwise("nothing")
    return steps(spark, sf_dir).select("qid", "t", online.filled_answer(answer, F.col("role"), read, F.col("discount") < 0.08).alias("answer"))


@query(f"""WITH {STEPS}, p AS (SELECT qid, t, unit, doc % 3 AS chunk, role, min(t) OVER (PARTITION BY qid, doc % 3) = t AS first FROM steps),
g AS (SELECT qid, chunk, min_by(role, t) AS role FROM p GROUP BY ALL), k AS (SELECT p.qid, p.t, p.chunk, g.role FROM p JOIN g USING (qid, chunk) WHERE first AND chunk <> 2)
SELECT qid, string_agg(unit::VARCHAR, ',' ORDER BY t) AS units, coalesce(any_value(covered), '') AS covered, coalesce(any_value(bridge), 0.0) AS k_bridge, coalesce(any_value(support), 0.0) AS k_support, max(t) AS last_step, string_agg('doc ' || unit || ' [' || t || '] text ' || t, chr(10) ORDER BY t) AS notebook
FROM p LEFT JOIN (SELECT qid, string_agg(chunk::VARCHAR, ',' ORDER BY t) AS covered, count(*) FILTER (role = 'bridge')::DOUBLE AS bridge, count(*) FILTER (role = 'support')::DOUBLE AS support FROM k GROUP BY qid) USING (qid) GROUP BY qid""")
def seed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of an order are its seeds; targets are two of three chunks, of the role of their first line."""
    rows = steps(spark, sf_dir).withColumn("chunk", F.col("doc") % 3)
    seeds = rows.select("qid", F.col("t").alias("rank"), F.col("unit").cast("string").alias("unit"), "chunk", F.concat(F.lit("doc "), F.col("unit").cast("string")).alias("doc"), F.col("t").alias("sent"), F.concat(F.lit("text "), F.col("t").cast("string")).alias("text"))
    targets = rows.where("chunk <> 2").groupBy("qid", "chunk").agg(F.min_by("role", "t").alias("role"))
    s = online.seed_state(seeds, targets)
    return s.select("qid", joined(F.transform("H_t", lambda h: h["unit_id"])).alias("units"), joined(F.col("A_t.covered_target_ids")).alias("covered"), F.col("A_t.k_br").alias("k_bridge"), F.col("A_t.k_sup").alias("k_support"), F.col("S_t.last_updated_step").cast("long").alias("last_step"), F.col("K_t").alias("notebook"))


@query(f"""WITH d AS (SELECT doc_id // 20 AS qid, doc_id AS doc, coalesce(text, '') AS text FROM documents), q AS (SELECT qid, min_by(text, doc) AS text FROM d GROUP BY qid), w AS (SELECT qid, doc, {TOK.format('text')} AS w FROM d), z AS (SELECT qid, doc, len(w) AS dl, w FROM w),
s AS (SELECT qid, count(*) AS n, avg(dl) AS avgdl FROM z GROUP BY qid), f AS (SELECT qid, doc, dl, term, count(*) AS tf FROM (SELECT qid, doc, dl, unnest(w) AS term FROM z) GROUP BY ALL), g AS (SELECT qid, term, count(*) AS df FROM f GROUP BY ALL),
i AS (SELECT qid, term, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM g JOIN s USING (qid)), m AS (SELECT qid, avg(idf) AS mean FROM i GROUP BY qid), k AS (SELECT qid, term, avgdl, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM i JOIN m USING (qid)),
a AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TOK.format('text')}) AS term FROM q) GROUP BY ALL)
SELECT d.qid, d.doc, coalesce(round(p.score, 6), 0) AS score FROM d LEFT JOIN (SELECT qid, doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM f JOIN k USING (qid, term) JOIN a USING (qid, term) GROUP BY ALL) p ON p.qid = d.qid AND p.doc = d.doc""")
def okapi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("qid"), F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    asked = docs.groupBy("qid").agg(F.min_by("text", "doc").alias("text"))
    return selection.okapi(docs, asked)


@query(f"""WITH {STEPS} SELECT qid, unit, max(greatest(score, quantity * 1000, discount * 100000)) AS score FROM steps GROUP BY qid, unit""")
def multi_query_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("variant"), c.cast("double").alias("score")) for i, c in enumerate((F.col("score"), F.col("quantity") * 1000, F.col("discount") * 100000)))))
    return selection.multi_query_max(steps(spark, sf_dir).select("qid", "unit", each.alias("e")).select("qid", "unit", "e.*"))


@query("""SELECT item_id, text || '|Find evidence that answers: ' || text || '|Find the bridge entity and final answer evidence for: ' || text || CASE WHEN item_id % 2 = 0 THEN '|' || text || chr(10) || 'Known evidence:' || chr(10) || 'item ' || item_id ELSE '' END AS variants, CASE WHEN item_id % 2 = 0 THEN 4 ELSE 3 END AS n FROM benchmark""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.query_variants(F.col("text"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" item "), F.col("item_id").cast("string"))))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(found, "|").alias("variants"), F.size(found).alias("n"))


@query(f"""WITH {STEPS}, c AS (SELECT qid, unit, row_number() OVER (PARTITION BY qid ORDER BY quantity::INTEGER % 4 DESC, role <> 'support' DESC, discount > 0.05 DESC, CASE WHEN role <> 'support' THEN 0 ELSE quantity::INTEGER % 3 END DESC, doc % 2, CASE WHEN role <> 'support' THEN 0 ELSE unit % 5 END DESC, unit::VARCHAR) AS r FROM steps) SELECT qid, unit FROM c WHERE r = 1""")
def teacher_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quantity").cast("int")
    rows = steps(spark, sf_dir).select("qid", F.lit(0).alias("t"), "unit", (q % 4).alias("utility"), (F.col("role") != "support").alias("raw"), (F.col("discount") > 0.05).alias("answer_facing"), (q % 3).alias("closure"), (F.col("doc") % 2).alias("kappa"), (F.col("unit") % 5).alias("priority"))
    return selection.teacher_choice(rows).select("qid", "unit")


@query(f"""WITH {STEPS}, d AS (SELECT qid, unit, min(t) AS pos FROM steps GROUP BY ALL), f AS (SELECT 'first' AS way, qid, unit, row_number() OVER (PARTITION BY qid ORDER BY pos, unit) AS pos FROM d), r AS (SELECT 'random' AS way, qid, unit, row_number() OVER (PARTITION BY qid ORDER BY sha256('11::' || qid || '::' || unit), unit) AS pos FROM d)
SELECT * FROM f WHERE pos <= 2 UNION ALL SELECT * FROM r WHERE pos <= 2""")
def plain_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = steps(spark, sf_dir).groupBy("qid", "unit").agg(F.min("t").alias("pos"))
    both = [selection.choose_first(pool, 2).withColumn("way", F.lit("first")), selection.choose_random(pool, 2, 11).withColumn("way", F.lit("random"))]
    return both[0].unionByName(both[1]).select("way", "qid", "unit", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {STEPS}, f AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY score DESC, t) AS rrf, row_number() OVER (PARTITION BY qid ORDER BY quantity DESC, t) AS dense, CASE WHEN t % 2 = 1 THEN row_number() OVER (PARTITION BY qid, t % 2 ORDER BY score DESC, t) END AS mmr FROM steps), z AS (SELECT *, max(mmr) OVER (PARTITION BY qid) AS size FROM f)
SELECT 'rrf_top30' AS variant, qid, t AS unit, rrf AS pos FROM z WHERE rrf <= 4 UNION ALL SELECT 'rrf_local_mmr10', qid, t, mmr FROM z WHERE mmr IS NOT NULL UNION ALL SELECT 'bge_top10', qid, t, dense FROM z WHERE dense <= 2
UNION ALL SELECT 'no_compression', qid, t, rrf FROM z UNION ALL SELECT 'oracle_target_preserving_mmr10', qid, t, CASE WHEN t = 0 THEN coalesce(size, 1) ELSE mmr END FROM z WHERE t = 0 OR (mmr IS NOT NULL AND mmr < size)""")
def compression_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = lambda c, *part: F.row_number().over(Window.partitionBy("qid", *part).orderBy(F.desc(c), "t"))
    front = steps(spark, sf_dir).select("qid", F.col("t").alias("unit"), rank("score").alias("rrf_rank"), rank("quantity").alias("dense_rank"), F.when(F.col("t") % 2 == 1, rank("score", F.col("t") % 2)).alias("mmr_rank"), (F.col("t") == 0).alias("positive"))
    return selection.compression_variants(front, 4, 2).select("variant", "qid", "unit", F.col("pos").cast("long").alias("pos"))


_J = "len(list_intersect(list_distinct({0}), list_distinct({1}))) / greatest(1, len(list_distinct(list_concat({0}, {1}))))"


@query(f"""WITH d AS (SELECT doc_id // 3 AS g, doc_id % 3 AS i, {TOK.format("coalesce(text, '')")} AS w, coalesce(source, '') AS p FROM documents), e AS (SELECT g, max(w) FILTER (i = 0) AS a, max(w) FILTER (i = 1) AS b, max(w) FILTER (i = 2) AS c, max(p) FILTER (i = 0) AS pa, max(p) FILTER (i = 1) AS pb, max(p) FILTER (i = 2) AS pc FROM d GROUP BY g),
j AS (SELECT *, b IS NOT NULL AND CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE {_J.format('a', 'b')} END < 0.85 AS u2, c IS NOT NULL AND CASE WHEN len(a) + len(c) = 0 THEN 1 ELSE {_J.format('a', 'c')} END < 0.85 AS s13, b IS NOT NULL AND c IS NOT NULL AND CASE WHEN len(b) + len(c) = 0 THEN 1 ELSE {_J.format('b', 'c')} END < 0.85 AS s23 FROM e), k AS (SELECT *, s13 AND (NOT u2 OR s23) AS u3 FROM j)
SELECT g, 1 + u2::INTEGER + u3::INTEGER >= 2 AND len(list_distinct(list_filter([pa, CASE WHEN u2 THEN pb ELSE '' END, CASE WHEN u3 THEN pc ELSE '' END], lambda x: x <> ''))) >= 2 AS composable FROM k""")
def composable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("g"), F.struct((F.col("doc_id") % 3).alias("i"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("parent")).alias("u"))
    rows = docs.groupBy("g").agg(F.array_sort(F.collect_list("u")).alias("us"))
    part = lambda f: F.transform("us", lambda u: u[f])
    return rows.select("g", selection.composable(part("text"), part("parent"), F.transform("us", lambda u: F.lit(True))).alias("composable"))


@query(f"""WITH {STEPS}, p AS (SELECT qid, t, unit % 50 AS u, doc % 3 AS pa, doc % 4 AS d, role, discount * 10 AS ratio, (discount > 0.04)::INTEGER AS flag FROM steps), l AS (SELECT *, {', '.join(f"lag({c}, {k}) OVER (PARTITION BY qid ORDER BY t) AS {c}{k}" for c in ("u", "pa", "d", "role", "flag") for k in (1, 2))} FROM p),
w AS (SELECT *, 0.05 * (coalesce(d = d1, false)::INTEGER + coalesce(d = d2, false)::INTEGER) + 0.10 * (coalesce(role = role1, false)::INTEGER + coalesce(role = role2, false)::INTEGER) AS base,
 CASE WHEN flag1 = 0 AND flag2 = 0 THEN 0.20 * (u = u1 OR u = u2)::INTEGER + 0.10 * (pa = pa1 OR pa = pa2)::INTEGER + CASE WHEN ratio >= 0.75 THEN 0.10 * (d = d1 OR d = d2)::INTEGER ELSE 0 END ELSE 0 END AS extra FROM l)
SELECT qid, t, round((base + extra) * CASE WHEN flag1 = 0 THEN 1.5 ELSE 1 END, 6) AS penalty FROM w""")
def repeat_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import trajectories as J

    unit = F.struct((F.col("unit") % 50).alias("unit"), (F.col("doc") % 3).alias("parent"), (F.col("doc") % 4).alias("doc"), F.col("role").alias("text"))
    rows = steps(spark, sf_dir).select("qid", "t", unit.alias("u"), (F.col("discount") > 0.04).cast("int").alias("flag"), (F.col("discount") * 10).alias("ratio"))
    before = J.step_window().rowsBetween(-2, -1)
    seen = rows.withColumn("recent", F.collect_list("u").over(before)).withColumn("flags", F.collect_list("flag").over(before))
    return seen.select("qid", "t", F.round(gates.repeat_penalty(F.col("u"), F.col("recent"), F.col("flags"), F.col("ratio")), 6).alias("penalty"))


@query(f"""WITH {STEPS}, n AS (SELECT qid, t, 'note about ' || unit % 7 AS text, list_value(CASE WHEN discount > 0.07 THEN 'x' ELSE 'a' END) || CASE WHEN quantity > 40 THEN ['b', 'b'] ELSE [] END AS src, role = 'support' AS bad FROM steps),
o AS (SELECT qid, t, text, list_filter([CASE WHEN text = 'note about 6' THEN 'duplicate_with_state' END, CASE WHEN len(src) <> len(list_distinct(src)) THEN 'duplicated_source_ids' END, CASE WHEN bad THEN 'invalid_type' END, CASE WHEN list_contains(src, 'x') THEN 'invisible_source_ids' END], lambda x: x IS NOT NULL) AS why FROM n),
d AS (SELECT *, coalesce(sum((len(why) = 0)::INTEGER) OVER (PARTITION BY qid, text ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS again FROM o)
SELECT qid, t::VARCHAR AS note_id, len(why) = 0 AND NOT again AS legal, array_to_string(list_sort(why || CASE WHEN again THEN ['duplicate_in_harvest'] ELSE [] END), ',') AS reasons FROM d""")
def legal_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.concat(F.array(F.when(F.col("discount") > 0.07, "x").otherwise("a")), F.when(F.col("quantity") > 40, F.array(F.lit("b"), F.lit("b"))).otherwise(F.array().cast("array<string>")))
    notes = steps(spark, sf_dir).select(
        "qid", F.col("t").cast("string").alias("note_id"), F.col("t").alias("pos"), F.when(F.col("role") != "support", "bridge_note").otherwise("support").alias("type"), F.concat(F.lit("note about "), (F.col("unit") % 7).cast("string")).alias("text"),
        sources.alias("sources"), F.array(F.lit("a"), F.lit("b")).alias("visible"), F.array(F.lit("Note about 6.")).alias("existing"),
    )
    return teacher.legality(notes).select("qid", "note_id", "legal", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {STEPS}, n AS (SELECT qid, t, CASE qid % 4 WHEN 0 THEN 'late_verification' WHEN 1 THEN 'early_bridge' WHEN 2 THEN 'trigger_only_candidate' END AS subtype, qid % 4 = 3 AND qid % 8 = 3 AS repair, role, discount > 0.05 AS facing, quantity::INTEGER % 5 AS closure, unit % 3 AS priority, doc % 3 AS sources FROM steps),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY facing DESC, closure DESC, priority, sources DESC, t) AS c, row_number() OVER (PARTITION BY qid ORDER BY role = 'bridge' DESC, priority, sources DESC, t) AS b FROM n)
SELECT qid, t, CASE WHEN repair OR coalesce(subtype = 'late_verification', false) THEN c <= 2 WHEN subtype = 'early_bridge' THEN b = 1 ELSE false END AS kept FROM k""")
def retained_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("qid") % 4
    notes = steps(spark, sf_dir).select(
        "qid", F.col("t").alias("note_id"), F.when(F.col("role") == "bridge", "bridge_note").otherwise("verification_note").alias("type"), (F.col("unit") % 3).alias("priority"), (F.col("doc") % 3).alias("sources"), (F.col("discount") > 0.05).alias("answer_facing"),
        (F.col("quantity").cast("int") % 5).alias("closure"), F.when(F.col("qid") % 8 == 3, "repair_after_false_stop").alias("mode"), F.when(q == 0, "late_verification").when(q == 1, "early_bridge").when(q == 2, "trigger_only_candidate").alias("subtype"),
    )
    return teacher.retention(notes).select("qid", F.col("note_id").alias("t"), "kept")


@query(f"""WITH {STEPS}, k AS (SELECT qid, t::VARCHAR AS unit, row_number() OVER (PARTITION BY qid ORDER BY discount > 0.05 DESC, quantity::INTEGER % 5 DESC, role = 'support' DESC, t::VARCHAR DESC) AS r FROM steps) SELECT qid, unit FROM k WHERE r = 1""")
def injected_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.struct(F.col("t").cast("string").alias("unit"), F.when(F.col("role") == "support", "verification_note").otherwise("bridge_note").alias("type"), (F.col("discount") > 0.05).alias("answer_facing"), (F.col("quantity").cast("int") % 5).alias("closure"))
    return steps(spark, sf_dir).groupBy("qid").agg(F.collect_list(note).alias("n")).select("qid", selection.repair_note(F.col("n")).alias("unit"))


@query(f"""WITH {STEPS} SELECT qid, t, CASE WHEN discount > 0.08 THEN 'answer_focus_verification' WHEN quantity > 20 AND discount > 0.02 AND quantity < 45 THEN 'bridge_query_entity_to_answer_candidate' WHEN role = 'bridge' AND NOT quantity < 45 THEN 'target_type_disambiguation' ELSE 'generic_bridge_or_verification' END AS goal,
 discount >= 0.05 AND quantity <= 30 AS hard FROM steps""")
def derive_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "bridge", "city").when(F.col("role") == "support", "generic").otherwise("yes_no")
    goal = gates.derive_goal(F.col("discount") > 0.08, F.col("quantity") > 20, kind, F.col("discount") > 0.02, F.col("quantity") < 45)
    return steps(spark, sf_dir).select("qid", "t", goal.alias("goal"), ((F.col("discount") >= 0.05) & (F.col("quantity") <= 30)).alias("hard"))


@query(f"""WITH {STEPS}, g AS (SELECT qid, t AS unit, row_number() OVER (PARTITION BY qid ORDER BY CASE role WHEN 'bridge' THEN 1 WHEN 'distinguish' THEN 2 ELSE 3 END, t) - 1 AS i FROM steps)
SELECT qid, i AS t, coalesce(string_agg(unit::VARCHAR, ',') OVER (PARTITION BY qid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context, unit AS positive, CASE WHEN unit IN (0, 99) THEN 2 ELSE 3 END AS n FROM g""")
def fixed_pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = steps(spark, sf_dir).select("qid", F.col("t").alias("unit"), "role", F.col("t").alias("pos"))
    pools = gold.select("qid").distinct().withColumn("pool", F.array(F.lit(0).cast("long"), F.lit(99).cast("long")))
    return datasets.state_rows(gold, pools).select("qid", F.col("t").cast("long").alias("t"), joined(F.col("context")).alias("context"), "positive", F.size("candidates").alias("n"))


@query(f"""WITH {STEPS}, g AS (SELECT qid, list(t ORDER BY t) AS gold FROM steps GROUP BY qid), p AS (SELECT qid, t, [x.t] AS seen FROM steps x WHERE discount > 0.05), o AS (SELECT qid, t, list_filter(gold, lambda u: NOT list_contains(seen, u)) AS left_ FROM p JOIN g USING (qid))
SELECT qid, t, t AS positive, 'teacher' AS source FROM steps UNION ALL SELECT qid, t, left_[1], 'rollout' FROM o WHERE len(left_) > 0""")
def rollout_aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    teacher_rows = rows.select("qid", "t", F.array().cast("array<bigint>").alias("context"), F.col("t").alias("positive"))
    own = rows.where("discount > 0.05").select("qid", "t", F.array("t").alias("context"))
    gold = rows.groupBy("qid").agg(F.array_sort(F.collect_list("t")).alias("gold"))
    return datasets.rollout_aligned(teacher_rows, own, gold).select("qid", "t", "positive", "source")


@query(f"""WITH {STEPS}, r AS (SELECT qid, t, unit % 4 AS parent, max(t) OVER (PARTITION BY qid) AS last FROM steps), s AS (SELECT qid, t, last, t >= last AS all_read FROM r), c AS (SELECT s.qid, s.t, r.t AS unit, r.parent, s.all_read OR r.t > s.t AS eligible,
 r.parent IN (0, 1) AND NOT EXISTS (SELECT 1 FROM r h WHERE h.qid = s.qid AND h.t <= s.t AND h.parent = r.parent) AS open FROM s JOIN r USING (qid)), p AS (SELECT qid, t, min(unit) FILTER (eligible AND open) AS aimed, min(unit) FILTER (eligible) AS first, max(unit) AS last FROM c GROUP BY ALL)
SELECT qid, t, coalesce(aimed, first) AS positive, aimed IS NOT NULL AS aimed, last AS negatives, (t + 1 - (coalesce(aimed, first) <= t)::INT) AS acquired, lag(coalesce(aimed, first)) OVER (PARTITION BY qid ORDER BY t) AS previous, coalesce(aimed, first) <> t AS changed FROM p""")
def coverage_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after each step, so that in the last one all of the pool is read; parents are part numbers modulo four, targets the first two."""
    own = steps(spark, sf_dir).withColumn("parent", F.col("unit") % 4)
    pools = own.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("unit"), "parent"))).alias("pool"))
    read = F.slice("pool", F.lit(1), (F.col("t") + 1).cast("int"))
    targets = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    states = own.select("qid", "t").join(pools, "qid").withColumn("read", read).select("qid", "t", "pool", F.transform("read", lambda x: x["unit"]).alias("history"), targets.alias("targets"), F.array_distinct(F.transform("read", lambda x: x["parent"])).alias("covered"), F.col("t").alias("positive"))
    size = lambda c: F.size(c).cast("long")
    return datasets.coverage_students(states).select("qid", "t", "positive", "aimed", size("negatives").alias("negatives"), size("acquired").alias("acquired"), "previous", "changed")


@query(f"""WITH {STEPS}, r AS (SELECT qid, list(t ORDER BY score DESC, t) AS ranked, count(*) AS n FROM steps GROUP BY qid), e AS (SELECT qid, ranked, list_position(ranked, 0) AS rank, ranked[1] AS predicted FROM r), k AS (SELECT qid, ranked[1:3] AS c, rank FROM e WHERE rank <= 3)
SELECT qid, array_to_string(c, ',') AS candidates, rank - 1 AS at FROM k WHERE len(c) >= 2""")
def hard_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "t")))
    rows = steps(spark, sf_dir).groupBy("qid").agg(F.transform(order, lambda x: x["t"]).alias("ranked")).select("qid", F.lit(0).alias("t"), F.lit(0).cast("long").alias("positive"), F.col("ranked")[0].alias("predicted"), F.array_position("ranked", F.lit(0).cast("long")).alias("rank"), "ranked")
    return datasets.hard_rows(rows, 3).select("qid", joined(F.col("candidates")).alias("candidates"), (F.array_position("labels", 1) - 1).alias("at"))


@query(f"""WITH {STEPS} SELECT qid, t, unit, k AS duplicate FROM steps, range(1, 3) r(k) WHERE quantity >= 30 AND discount <= 0.03""")
def focus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    records = rows.select("qid", "t", F.col("quantity").alias("policy_rank"), F.col("discount").alias("kept_rank"))
    return datasets.focus_rows(rows.select("qid", "t", "unit"), records, 30, 0.03, 2).select("qid", "t", "unit", F.col("duplicate").cast("long").alias("duplicate"))


@query("""SELECT o_orderkey::VARCHAR AS qid, o_totalprice, o_orderpriority FROM orders""")
def projected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.project(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice", "o_orderpriority"])


@query("""SELECT item_id::VARCHAR AS qid, trim(text) AS question, 'item ' || item_id AS answer, 'hotpotqa_distractor' AS dataset, 'dev' AS split, 'bridge' AS type, 'level' AS level FROM benchmark""")
def query_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.concat(F.lit(" item "), F.col("item_id").cast("string")).alias("answer"), F.lit(" bridge").alias("type"), F.lit("level ").alias("level"))
    return adapters.query_records(rows, "dev").select("qid", "question", "answer", "metadata.*")


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions: lines are paragraphs, those with a high discount support, and each rule is broken by some."""
    s = steps(spark, sf_dir)
    paragraph = F.struct(F.col("t").cast("int").alias("idx"), F.when(F.col("t") % 2 == 0, "").otherwise("title").alias("title"), F.when((F.col("quantity") == 50), " ").otherwise(F.concat(F.lit("text "), F.col("unit").cast("string"))).alias("text"), (F.col("discount") >= 0.05).alias("supporting"))
    rows = s.groupBy("qid").agg(F.collect_list(paragraph).alias("paragraphs"), F.array_sort(F.collect_list(F.when(F.col("discount") >= 0.05, F.col("t").cast("int")))).alias("d"))
    order = F.when(F.col("qid") % 11 == 0, F.concat("d", F.array(F.lit(77)))).when(F.col("qid") % 13 == 0, F.concat("d", F.slice("d", 1, 1))).otherwise(F.col("d"))
    return adapters.chained_rows(rows.select(F.col("qid").cast("string").alias("qid"), F.lit(" why? ").alias("question"), F.when(F.col("qid") % 17 == 0, "").otherwise("so").alias("answer"), F.lit(True).alias("answerable"), "paragraphs", order.alias("decomposition"), F.array(F.lit("so"), F.lit("x "), F.lit("x")).alias("aliases")))


_PROBLEMS = f"""{STEPS}, c AS (SELECT qid, count(*) AS n, count(*) FILTER (discount >= 0.05) AS s, count(*) FILTER (quantity = 50) AS blank FROM steps GROUP BY qid), r AS (SELECT *, CASE WHEN qid % 17 = 0 THEN 'incomplete' WHEN s + (qid % 11 = 0)::INTEGER = 0 THEN 'no decomposition' WHEN blank > 0 THEN 'empty paragraph' WHEN qid % 11 = 0 THEN 'absent support' WHEN qid % 13 = 0 THEN 'support not one to one' END AS problem FROM c)"""


@query(f"""WITH {_PROBLEMS} SELECT coalesce(problem, 'usable') AS problem, count(*) AS n, sum(n)::BIGINT AS paragraphs FROM r GROUP BY ALL""")
def chained_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chained(spark, sf_dir).groupBy(F.coalesce("problem", F.lit("usable")).alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("paragraphs")).alias("paragraphs"))


@query(f"""WITH {_PROBLEMS}, g AS (SELECT qid, steps.t AS idx, row_number() OVER (PARTITION BY qid ORDER BY steps.t) - 1 AS t, r.n FROM steps JOIN r USING (qid) WHERE problem IS NULL AND discount >= 0.05)
SELECT qid::VARCHAR AS qid, t, qid || '::' || idx AS positive, coalesce(string_agg(qid || '::' || idx, ',') OVER (PARTITION BY qid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context, n - t AS candidates FROM g""")
def evaluation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = adapters.evaluation_set(_chained(spark, sf_dir))
    return made["samples"].select("qid", F.col("t").cast("long").alias("t"), "positive", F.array_join("context", ",").alias("context"), F.size("candidates").cast("long").alias("candidates"))


@query(f"""WITH {STEPS} SELECT o_orderkey AS qid, count(*) AS docs, sum(unit)::BIGINT AS units FROM orders JOIN steps ON o_orderkey = qid GROUP BY ALL""")
def grouped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"))
    return adapters.grouped_join(asked, steps(spark, sf_dir)).groupBy("qid").agg(F.count(F.lit(1)).alias("docs"), F.sum("unit").alias("units"))


@query("""SELECT count(*) AS leaking FROM events WHERE regexp_matches(props, '"(k)"\\s*:')""")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.forbidden_rows(table(spark, sf_dir, "events"), "props", ["k"]).agg(F.count(F.lit(1)).alias("leaking"))


@query(f"""WITH {STEPS}, n AS (SELECT qid, (doc % 4)::VARCHAR AS note_id, min(unit % 3) AS priority, min(t) AS t FROM steps GROUP BY ALL) SELECT qid, note_id, 'bridge_note' AS type, priority, t, row_number() OVER (PARTITION BY qid ORDER BY priority, note_id) AS place FROM n""")
def consolidated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = steps(spark, sf_dir).select("qid", "t", (F.col("doc") % 4).cast("string").alias("note_id"), F.lit("bridge_note").alias("type"), F.concat(F.lit("n"), F.col("doc") % 4).alias("text"), F.array(F.lit("a")).alias("sources"), (F.col("unit") % 3).alias("priority"))
    return adapters.consolidated_notes(notes).select("qid", "note_id", "type", "priority", "t", F.col("place").cast("long").alias("place"))
