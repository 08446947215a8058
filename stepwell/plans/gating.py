"""Queries over gates, answer checks, notes and the shapes of input rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets as D
from ..operators import frontend
from ..operators import gates as G
from ..operators import online
from ..operators import retrieval as R
from ..operators import teacher
from ..operators import trajectories as J
from ..operators import units as U
from ..sources.json import lenient_bool
from ..sources.tables import cut
from ..streaming import state
from .registry import STEPS, dealt, query, steps, table
from .retrieval import _D, _Q, TOK, _docs, _questions, bm25_sql
from .retrieval import CUT as _CUT
from .texts import NORM

_NUM = "regexp_extract_all({}, '\\d+(?:[./:-]\\d+)*')"
_MONTHS = "|".join(T.MONTHS)


@query(f"""WITH p AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || ' ' || (event_id % 7) END AS gold,
 CASE event_id % 5 WHEN 0 THEN upper(event_type) || ' ' || (event_id % 7) || '.' WHEN 1 THEN 'the ' || event_type || ' ' || (event_id % 4) WHEN 2 THEN 'a ' || event_type WHEN 3 THEN event_type || 's' END AS probe FROM events),
n AS (SELECT *, {NORM.format('gold')} AS a, {NORM.format('probe')} AS b, {_NUM.format('gold')} AS x, {_NUM.format('probe')} AS y, regexp_matches(lower(gold), '\\d|{_MONTHS}') OR regexp_matches(lower(probe), '\\d|{_MONTHS}') AS num FROM p),
c AS (SELECT *, a = b OR (len(x) > 0 AND x = y) AS correct FROM n), d AS (SELECT *, coalesce(a <> '' AND b <> '' AND (correct OR CASE WHEN num THEN contains(b, a) ELSE contains(' ' || b || ' ', ' ' || a || ' ') END), false) AS compatible FROM c)
SELECT event_id, coalesce(correct, false) AS correct, compatible, coalesce(a <> '' AND b <> '' AND a <> b AND CASE WHEN len(x) > 0 OR len(y) > 0 THEN x <> y ELSE NOT compatible END, false) AS conflict FROM d""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, id_ = F.col("event_type"), F.col("event_id")
    number = lambda n: F.concat(F.lit(" "), (id_ % n).cast("string"))
    gold = F.when(id_ % 3 == 0, kind).otherwise(F.concat(kind, number(7)))
    probe = F.when(id_ % 5 == 0, F.concat(F.upper(kind), number(7), F.lit("."))).when(id_ % 5 == 1, F.concat(F.lit("the "), kind, number(4))).when(id_ % 5 == 2, F.concat(F.lit("a "), kind)).when(id_ % 5 == 3, F.concat(kind, F.lit("s")))
    rows = table(spark, sf_dir, "events").select("event_id", gold.alias("g"), probe.alias("p"))
    g, p = F.col("g"), F.col("p")
    return rows.select("event_id", F.coalesce(T.answer_correct(g, p), F.lit(False)).alias("correct"), T.answer_compatible(g, p).alias("compatible"), T.answer_conflicts(g, p).alias("conflict"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'It ' || text ELSE text END AS text FROM documents), b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS b FROM t),
f AS (SELECT doc_id, CASE WHEN regexp_matches(b, '[.!?]\\s') THEN regexp_extract(b, '^((?s).*?[.!?])\\s', 1) ELSE b END AS f FROM b), s AS (SELECT doc_id, CASE WHEN f = '' THEN '' WHEN regexp_matches(f, '[.!?]$') THEN f ELSE f || '.' END AS sentence FROM f)
SELECT doc_id, sentence, CASE WHEN regexp_matches(sentence, '^(?i)(she|he|they|it)\\b') THEN 'Page $' || doc_id || substr(sentence, length(regexp_extract(sentence, '^(?i)(she|he|they|it)\\b', 1)) + 1) ELSE sentence END AS note FROM s""")
def note_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other text is led by a pronoun."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("It "), F.col("text"))).otherwise(F.col("text")).alias("text"))
    name = F.concat(F.lit("Page $"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", T.single_sentence(F.col("text")).alias("sentence"), T.note_text(name, F.col("text")).alias("note"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS tokens, CASE WHEN NOT regexp_matches(text, '\\S') THEN 0 ELSE greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\\S')))) END AS sentences,
 length(array_to_string(list_filter(string_split('[bridge] a' || chr(10) || text || chr(10) || ' Notes: b', chr(10)), lambda x: NOT regexp_matches(trim(x), '^(\\[derived_note\\]|Notes:|\\[bridge\\]|\\[verification\\])')), chr(10))) AS stripped FROM documents""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, noted = F.col("text"), F.concat(F.lit("[bridge] a\n"), F.col("text"), F.lit("\n Notes: b"))
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(text).cast("long").alias("tokens"), T.sentence_count(text).cast("long").alias("sentences"), F.length(T.strip_note_lines(noted)).cast("long").alias("stripped"))


@query("""WITH v AS (SELECT event_id, value, (['TRUE', ' no ', '1', 'maybe', '0', NULL])[event_id % 6 + 1] AS raw FROM events)
SELECT event_id, CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(raw)) IN ('false', '0', 'no', 'n') THEN false END AS flag, greatest(0.0, least(1.0, value / 200 - 0.25)) AS share FROM v""")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["TRUE", " no ", "1", "maybe", "0", None])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", lenient_bool(raw).alias("flag"), T.clamp(F.col("value") / 200 - 0.25).alias("share"))


@query(f"""WITH {STEPS}, l AS (SELECT qid, list(doc % 3 ORDER BY t) AS title, list(t % 2 ORDER BY t) AS sent_id FROM steps GROUP BY qid) SELECT qid, len(list_distinct(list_zip(title, sent_id))) AS facts, len(title) AS entries, title[1] AS first_title, 2 AS first_sentences FROM l""")
def normalized_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columnar facts and contexts as arrays of structs."""
    ordered = F.array_sort(F.collect_list(F.struct("t", (F.col("doc") % 3).alias("title"))))
    rows = steps(spark, sf_dir).groupBy("qid").agg(ordered.alias("o"))
    part = lambda f: F.transform("o", f)
    columnar = rows.select("qid", F.struct(part(lambda x: x["title"]).alias("title"), part(lambda x: x["t"] % 2).alias("sent_id"), part(lambda x: F.array(F.lit("a"), F.lit("b"))).alias("sentences")).alias("c"))
    shaped = columnar.select("qid", U.normalize_facts(F.col("c")).alias("f"), U.normalize_context(F.col("c")).alias("x"))
    return shaped.select("qid", F.size("f").cast("long").alias("facts"), F.size("x").cast("long").alias("entries"), F.col("x")[0]["title"].alias("first_title"), F.size(F.col("x")[0]["sentences"]).alias("first_sentences"))


@query(f"""WITH c AS (SELECT doc_id, text, {_CUT} AS s FROM documents) SELECT doc_id, length(text) AS chars, rtrim(left(trim(array_to_string(s[1:2], ' ')), 200)) AS summary, len(s) AS atoms FROM c""")
def chunk_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return U.chunks(docs).select("doc_id", F.length("chunk_text").cast("long").alias("chars"), F.col("summary_text").alias("summary"), F.size(T.sentences(F.col("chunk_text"))).cast("long").alias("atoms"))


@query(f"""WITH c AS (SELECT doc_id, len({_CUT}) AS n FROM documents) SELECT doc_id AS qid, n AS units, (n > doc_id % 4)::BIGINT AS supporting, (n <= doc_id % 4)::BIGINT AS unresolved FROM c WHERE n > 0""")
def support_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of one-page contexts marked by a fact each, and the facts that no unit matches."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), T.sentences(F.col("text")).alias("sentences")).where(F.size("sentences") > 0)
    units = U.context_units(docs.select("qid", F.array(F.struct(F.lit("page").alias("title"), "sentences")).alias("context")))
    facts = docs.select("qid", F.lit("page").alias("title"), (F.col("qid") % 4).cast("int").alias("sent_id"))
    marked = U.with_support(units, facts).groupBy("qid").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("is_supporting").cast("long")).alias("supporting"))
    lost = U.unresolved_facts(units, facts).select("qid", F.lit(1).cast("long").alias("u"))
    return marked.join(lost, "qid", "left").select("qid", "units", "supporting", F.coalesce("u", F.lit(0).cast("long")).alias("unresolved"))


@query(f"""WITH {STEPS} SELECT qid, t, role = 'bridge' AS note, role <> 'bridge' AND quantity <= 40 AS raw, CASE WHEN role <> 'bridge' AND quantity > 45 THEN NULL WHEN role <> 'bridge' AND quantity > 40 THEN qid::VARCHAR WHEN role = 'bridge' THEN qid || '::derived' ELSE qid || '::' || doc END AS chunk FROM steps""")
def unit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    whole = F.concat_ws("::", s("qid"), F.when(F.col("role") == "bridge", "derived").otherwise(s("doc")), s("t"))
    unit = F.when((F.col("role") == "bridge") | (F.col("quantity") <= 40), whole).when(F.col("quantity") > 45, F.concat_ws("::", s("qid"), s("doc"), F.concat(s("t"), F.lit("a")))).otherwise(F.concat_ws("::", s("qid"), s("t")))
    return steps(spark, sf_dir).select("qid", "t", T.is_note(unit).alias("note"), T.is_raw(unit).alias("raw"), T.unit_chunk(unit).alias("chunk"))


@query(f"""WITH {STEPS} SELECT qid, coalesce(string_agg(unit || '@' || CASE WHEN doc % 2 = 0 THEN t ELSE 0 END, ',' ORDER BY t), '') AS refs FROM (SELECT * FROM steps WHERE role <> 'bridge' UNION ALL SELECT qid, 0, NULL, NULL, NULL, NULL, NULL, NULL FROM steps WHERE role = 'bridge') GROUP BY qid""")
def minimal_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a unit are dropped, those without a step get 0."""
    ref = F.struct(F.when(F.col("role") != "bridge", F.col("unit")).alias("unit_id"), F.when(F.col("doc") % 2 == 0, F.col("t")).alias("added_step"))
    rows = steps(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("t", ref.alias("r")))).alias("o"))
    refs = online.plain_refs(F.transform("o", lambda x: x["r"]))
    return rows.select("qid", F.array_join(F.transform(refs, lambda r: F.concat_ws("@", r["unit_id"], r["added_step"].cast("string"))), ",").alias("refs"))


@query(f"""WITH {STEPS}, s AS (SELECT qid, count(*) FILTER (role = 'support') AS facts, count(*) FILTER (role = 'support' AND discount < 0.09) AS resolved, count(*) FILTER (role = 'distinguish') AS others FROM steps GROUP BY qid)
SELECT qid, CASE WHEN qid % 11 = 0 THEN 'missing_question' WHEN qid % 13 = 0 THEN 'missing_answer' WHEN facts = 0 THEN 'no_facts' WHEN resolved < facts THEN 'unresolved_fact' WHEN others = 0 THEN 'no_distractor' ELSE '' END AS reason FROM s""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    support = F.col("role") == "support"
    rows = steps(spark, sf_dir).groupBy("qid").agg(n(support).alias("f"), n(support & (F.col("discount") < 0.09)).alias("r"), n(F.col("role") == "distinguish").alias("d"))
    return rows.select("qid", U.valid_reason(F.when(F.col("qid") % 11 != 0, "q"), F.when(F.col("qid") % 13 == 0, " ").otherwise("a"), F.col("f"), F.col("r"), F.col("d")).alias("reason"))


@query(f"""WITH {STEPS}, s AS (SELECT qid, max(CASE WHEN role = 'bridge' THEN discount END) * 10 AS b, max(CASE WHEN role = 'support' THEN discount END) * 10 AS s, max(quantity) > 45 AS red, list(role ORDER BY t) AS roles, max_by(discount, t) > 0.05 AS went FROM steps GROUP BY qid),
v AS (SELECT *, list_filter([b, s], lambda x: x IS NOT NULL) AS sc, list_contains(roles[-2:], 'distinguish') AS chk, list_contains(roles[-2:], 'bridge') AS br FROM s),
w AS (SELECT *, len(list_filter(sc, lambda x: x < 0.7)) = 0 AS complete, len(sc) > 0 AND len(list_filter(sc, lambda x: x < 0.55)) = 0 AS near, chk OR (red AND br) AS settled FROM v)
SELECT qid, near, settled, complete AND (settled OR (NOT went AND near)) AS stop, CASE WHEN red THEN 'late_verification' WHEN len(roles) <= 2 AND br THEN 'early_bridge' WHEN near THEN 'trigger_only_candidate' END AS subtype FROM w""")
def legacy_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda r: F.max(F.when(F.col("role") == r, F.col("discount"))) * 10
    ordered = F.array_sort(F.collect_list(F.struct("t", "role", (F.col("discount") > 0.05).cast("int").alias("p"))))
    rows = steps(spark, sf_dir).groupBy("qid").agg(F.array_compact(F.array(by("bridge"), by("support"))).alias("scores"), (F.max("quantity") > 45).alias("red"), ordered.alias("o"))
    rows = rows.withColumn("roles", F.transform("o", lambda x: x["role"])).withColumn("progress", F.transform("o", lambda x: x["p"]))
    check, bridge = G.recent_note(F.col("roles"), "distinguish"), G.recent_note(F.col("roles"), "bridge")
    settled = teacher.no_note_needed(check, F.col("red"), bridge)
    near = teacher.near_complete(F.col("scores"))
    return rows.select("qid", near.alias("near"), settled.alias("settled"), teacher.legacy_stop(F.col("scores"), settled, F.col("progress")).alias("stop"), teacher.note_subtype(F.col("red"), F.size("roles") - 1, bridge, near).alias("subtype"))


@query(f"""WITH {STEPS} SELECT qid, t, discount > 0.02 AND quantity > 10 AND doc % 2 = 0 AS teacher_stop, NOT (discount > 0.02 AND quantity > 10 AND doc % 2 = 0) AS false_stop,
 round((discount + discount * 2 + discount * 3 + 1.5 * quantity / 50) / CASE WHEN role = 'bridge' THEN 1.15 WHEN role = 'distinguish' THEN 1.2 WHEN unit % 2 = 0 THEN 1.1 ELSE 1.0 END, 6) AS utility FROM steps""")
def probe_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("discount").cast("double")
    probe = teacher.stop_probe(d > 0.02, F.col("quantity") > 10, F.col("doc") % 2 == 0)
    cost = J.kappa(F.when(F.col("role") == "bridge", "bridge_note").when(F.col("role") == "distinguish", "verification_note"), F.when(F.col("unit") % 2 == 0, "chunk"))
    value = J.utility({"bridge": d, "distinguish": d * 2, "support": d * 3}, F.col("quantity").cast("double") / 50, cost)
    return steps(spark, sf_dir).select("qid", "t", *(c.alias(n) for n, c in probe.items()), F.round(value, 6).alias("utility"))


@query(f"""WITH {STEPS}, p AS (SELECT qid, min(t) FILTER (quantity > 10 AND role = 'support' AND discount <= 0.05) AS aimed, min(t) FILTER (quantity > 10) AS usable, coalesce(min(t) FILTER (role = 'support' AND discount <= 0.05), min(t)) AS whole FROM steps GROUP BY qid) SELECT qid, coalesce(aimed, usable, whole) AS positive FROM p""")
def coverage_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents are (role, whether the discount is high); supports are targets, those with a high discount are covered."""
    high = F.when(F.col("discount") > 0.05, "high").otherwise("low")
    one = F.struct("t", F.col("t").alias("unit"), F.concat_ws("-", "role", high).alias("parent"), (F.col("quantity") > 10).alias("eligible"))
    pools = steps(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("pool"))
    targets, covered = F.array(F.lit("support-high"), F.lit("support-low")), F.array(F.lit("support-high"))
    return pools.select("qid", D.coverage_positive(F.col("pool"), targets, covered).alias("positive"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.windowed(table(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "value")


@query(f"""WITH top AS (WITH {bm25_sql(_D, _Q)}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM scores) SELECT qid, doc FROM r WHERE rank <= 8),
c AS (SELECT doc_id AS doc, {_CUT} AS s FROM documents WHERE doc_id IN (SELECT doc FROM top)), a AS (SELECT doc, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS sent_id FROM c), w AS (SELECT doc, sent_id, {TOK.format('text')} AS w FROM a),
st AS (SELECT doc, count(*) AS n, avg(len(w)) AS avgdl FROM w GROUP BY doc), tf AS (SELECT doc, sent_id, term, count(*) AS tf FROM (SELECT doc, sent_id, unnest(w) AS term FROM w) GROUP BY ALL), df AS (SELECT doc, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS qid, unnest({TOK.format('text')}) AS term FROM benchmark WHERE item_id % 100 = 0),
sc AS (SELECT qid, doc, sent_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(tf + 1.5 * (1 - 0.75 + 0.75 * len(w) / greatest(avgdl, 1e-12)), 1e-12)), 6) AS score FROM top JOIN q USING (qid) JOIN tf USING (doc, term) JOIN df USING (doc, term) JOIN st USING (doc) JOIN w USING (doc, sent_id) GROUP BY ALL),
u AS (SELECT qid, doc, sent_id, doc || '::' || sent_id AS unit, coalesce(score, 0) AS score FROM top JOIN w USING (doc) LEFT JOIN sc USING (qid, doc, sent_id) WHERE (doc + sent_id) % 5 > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, unit) AS best FROM u) SELECT qid, doc, unit, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM b WHERE best = 1""")
def best_unused_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each question's eight chunks the best atom by BM25 within the chunk; every fifth atom counts as used."""
    asked = _questions(spark, sf_dir)
    top = R.top_k(R.bm25(_docs(spark, sf_dir), asked), 8).select("qid", F.col("doc").alias("chunk"))
    chosen = dealt(table(spark, sf_dir, "documents")).join(top.select(F.col("chunk").alias("doc_id")).distinct(), "doc_id", "left_semi")
    atoms = U.units(chosen).select(F.col("doc").alias("chunk"), F.col("unit_id").alias("unit"), "sent_id", "text")
    used = top.join(atoms.where((F.col("chunk") + F.col("sent_id")) % 5 == 0), "chunk").select("qid", "unit")
    out = R.best_unused_atoms(top, atoms, asked, used)
    return out.select("qid", F.col("chunk").alias("doc"), "unit", "score", F.col("rank").cast("long").alias("rank"))


@query()
def rebuilt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each question from the sentences of its eight chunks; the second channel is token overlap. Tested against a plain version."""
    asked = _questions(spark, sf_dir)
    top = cut(R.bm25_top(_docs(spark, sf_dir), asked, 8).select("qid", F.col("doc").alias("doc_id")))  # named twice, searched for once
    chosen = dealt(table(spark, sf_dir, "documents")).join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    pool = U.units(chosen).join(top.withColumnRenamed("doc_id", "doc"), "doc").select("qid", F.col("unit_id").alias("unit"), "doc", "sent_id", "text").persist()  # eight chunks a question, read by every channel
    dense = pool.join(asked.withColumnRenamed("text", "question"), "qid").select("qid", "unit", F.round(T.jaccard(T.tokens(F.col("question")), T.tokens(F.col("text")), 0.0), 6).alias("score"))
    positives = pool.groupBy("qid").agg(F.max("unit").alias("unit"))
    return frontend.rebuild(pool, dense, asked, positives)
