"""Queries over texts: units, normalisers, kinds and set functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import units as U
from ..operators.trajectories import cyclic_next
from ..operators.retrieval import blocks
from .registry import dealt, query, table

TOK = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({})), '\s+', ' ', 'g'), '[\"''“”‘’`.,;:!?()\[\]{{}}]', '', 'g'), '\s+', ' ', 'g'))"


@query(r"""WITH u AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id AS doc, count(*) AS units, sum(length(s))::BIGINT AS chars FROM (SELECT doc_id, trim(s, ' ') AS s FROM u) WHERE s <> '' GROUP BY doc_id""")
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.units(table(spark, sf_dir, "documents")).groupBy("doc").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT doc_id, {NORM.format('text')} AS normal, len({TOK.format('text')}) AS tokens, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS token_count FROM documents")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(text).alias("normal"), F.size(T.tokens(text)).cast("long").alias("tokens"), T.token_count(text).cast("long").alias("token_count"))


@query(f"""WITH p AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM benchmark), t AS (SELECT item_id, {TOK.format('text')} AS a, {TOK.format('other')} AS b FROM p WHERE other IS NOT NULL)
SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, len(list_intersect(a, b)) AS overlap,
 array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x) AND length(x) >= 3 AND x NOT IN ({", ".join(repr(w) for w in T.STOPWORDS)}))), ' ') AS novel FROM t""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    after = cyclic_next(items.withColumn("all", F.lit(0)), "item_id", "all").where("paired > item_id").select("item_id", "paired")
    pairs = items.join(after, "item_id").join(items.select(F.col("item_id").alias("paired"), F.col("text").alias("other")), "paired")
    a, b = T.tokens(F.col("text")), T.tokens(F.col("other"))
    return pairs.select("item_id", F.round(T.jaccard(a, b), 6).alias("jaccard"), T.overlap(a, b).cast("long").alias("overlap"), F.array_join(T.novel_tokens(F.col("text"), F.col("other")), " ").alias("novel"))


_QUESTIONS = [
    "Is the river long?", "How many years did it last?", "Which branch of mathematics is it?", "What river runs there?", "Which university did he attend?", "What county is it in?",
    "Which city was first?", "What state?", "What year was it founded?", "When was it built?", "What profession did she have?", "Which types of plant grow?", "Who wrote it?",
    "Where was he born?", "Which magazine was started first, A or B?", "Whose is it?", "How much is 12.5 of 3/4?", "who", "",
]
_AUX = "|".join(T.AUXILIARIES)


@query(
    f"""WITH q AS (SELECT item_id, ([{", ".join("'" + q + "'" for q in _QUESTIONS)}])[item_id % {len(_QUESTIONS)} + 1] || ' ' || text AS question FROM benchmark), l AS (SELECT item_id, question, trim(lower(question)) AS q, rtrim(lower(trim(question)), '?') AS g,
 array_to_string(regexp_extract_all(lower(question), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), ' ') AS c FROM q)
SELECT item_id, regexp_matches(q, '^({_AUX}) ') AS yes_no,
 CASE WHEN regexp_matches(q, '^({_AUX}) ') THEN 'yes_no' WHEN regexp_matches(q, '\\bhow\\s+(many\\s+)?(hours?|days?|weeks?|months?|years?)\\b') THEN 'duration'
 WHEN regexp_matches(q, '\\bwhich\\s+branch\\s+of\\s+mathematics\\b') THEN 'math_branch' """
    + " ".join(f"WHEN regexp_matches(q, '\\b(what|which)\\s+{k}\\b') THEN '{k}'" for k in ("river", "university", "county", "city", "state"))
    + f""" WHEN regexp_matches(q, '\\b(what|which)\\s+year\\b') OR starts_with(q, 'when ') OR ((contains(q, 'originally') OR contains(q, 'first')) AND regexp_matches(q, '\\b(performed|written|built|made|released|founded)\\b')) THEN 'year'
 WHEN regexp_matches(q, '\\b(what|which)\\s+(profession|job|occupation)\\b') THEN 'profession' WHEN regexp_matches(q, '\\b(types|kind) of plant\\b') THEN 'plant' WHEN starts_with(q, 'who ') THEN 'person' ELSE 'generic' END AS focus,
 CASE WHEN regexp_matches(c, '^(who|whom|whose) ') THEN 'person' WHEN starts_with(c, 'when ') THEN 'date or time' WHEN starts_with(c, 'where ') THEN 'location' WHEN regexp_matches(c, '^how (many|much) ') THEN 'number'
 WHEN regexp_matches(c, '^what (city|country|location|place) ') THEN 'location' WHEN regexp_matches(c, '^what (year|date|time) ') THEN 'date or time' WHEN starts_with(c, 'which ') THEN 'named choice' ELSE 'answer entity or value' END AS answer_type,
 CASE {" ".join(f"WHEN regexp_matches(g, '{p}') THEN '{n}'" for p, n in T.GOALS)} ELSE '{T.DEFAULT_GOAL}' END AS goal,
 regexp_matches(lower(question), '\\d|{"|".join(T.MONTHS)}') AS number_like, array_to_string(regexp_extract_all(question, '\\d+(?:[./:-]\\d+)*'), ' ') AS numbers FROM l"""
)
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item, led by one of the questions by turns."""
    q, led = F.col("question"), F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("item_id") % len(_QUESTIONS) + 1).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(led, F.lit(" "), F.col("text")).alias("question"))
    return rows.select("item_id", T.is_yes_no(q).alias("yes_no"), T.focus_kind(q).alias("focus"), T.answer_type(q).alias("answer_type"), T.goal(q).alias("goal"), T.number_like(q).alias("number_like"), F.array_join(T.numeric_tokens(q), " ").alias("numbers"))


@query("""SELECT doc_id, sha256('7::' || doc_id) AS order_key, rtrim(left(trim(text), 80)) AS short, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(left(text, 77)) || '...' END AS dotted FROM documents""")
def stable_keys_and_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_key(7, F.col("doc_id")).alias("order_key"), T.shorten(F.col("text"), 80).alias("short"), T.shorten_dots(F.col("text"), 80).alias("dotted"))


@query("""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][A-Za-z0-9''&().-]+(?:\\s+[A-Z][A-Za-z0-9''&().-]+)*') AS phrases FROM documents),
e AS (SELECT doc_id, phrases, unnest(phrases) AS phrase, generate_subscripts(phrases, 1) AS i FROM d)
SELECT d.doc_id, len(list_distinct(d.phrases)) AS phrases, coalesce(max_by(phrase, length(phrase) * 10000000 - i), '') AS longest FROM d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id, d.phrases""")
def capitalized_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.capitalized_phrases(F.col("text"))
    longest = F.array_max(F.transform(found, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("phrases"), F.coalesce(longest, F.lit("")).alias("longest"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT % 3 AS bucket, coalesce(props->>'$.missing', props->>'$.k') AS first_hit FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.json import alias_path

    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), (k.cast("long") % 3).alias("bucket"), alias_path(F.get_json_object("props", "$.missing"), k).alias("first_hit"))


@query("""WITH s AS (SELECT o_custkey AS c, list(DISTINCT o_orderpriority) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), t AS (SELECT o_custkey AS c, list(DISTINCT o_orderpriority) AS b FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
SELECT c, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset,
 len(list_distinct(list_concat(a, b))) AS all_n FROM s JOIN t USING (c)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c")
    a = orders.where("o_orderstatus = 'F'").groupBy("c").agg(F.collect_set("o_orderpriority").alias("a"))
    b = orders.where("o_orderstatus <> 'F'").groupBy("c").agg(F.collect_set("o_orderpriority").alias("b"))
    return a.join(b, "c").select(
        "c", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("only_a"),
        (F.size(F.array_except("b", "a")) == 0).alias("subset"), F.size(F.array_union("a", "b")).cast("long").alias("all_n"),
    )


@query("""(SELECT o_custkey AS id, 'both' AS side FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer) UNION ALL (SELECT c_custkey, 'customer' FROM customer EXCEPT SELECT o_custkey, 'customer' FROM orders)""")
def split_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(b.subtract(a).withColumn("side", F.lit("customer")))


@query(f"""WITH q AS (SELECT item_id, text AS question FROM benchmark WHERE item_id % 100 = 0), d AS (SELECT doc_id, text FROM documents),
x AS (SELECT doc_id, item_id, {NORM.format('text')} AS nt, {NORM.format("question")} AS na, len(list_intersect(list_distinct({TOK.format('question')}), {TOK.format('text')})) AS overlap FROM d, q)
SELECT item_id, CASE WHEN na <> '' AND contains(nt, na) THEN 'support' WHEN overlap >= 2 THEN 'bridge' ELSE 'distinguish' END AS role, count(*) AS n FROM x GROUP BY ALL""")
def rule_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search: every item whose number is divisible by 100 against all documents; each side is normalised once, and the questions travel in blocks of bounded size."""
    asked = table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select("item_id", T.normalize(F.col("text")).alias("q"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    docs = dealt(table(spark, sf_dir, "documents").select("text")).select(T.normalize(F.col("text")).alias("norm"), F.array_distinct(T.tokens(F.col("text"))).alias("have"))
    role = T.role_by(F.col("q"), F.col("words"), F.col("q"), F.col("norm"), F.col("have"), F.lit(""))
    parts = [docs.crossJoin(F.broadcast(b)).select("item_id", role.alias("role")) for b in blocks(asked, "item_id", 4096)]
    return reduce(DataFrame.unionByName, parts).groupBy("item_id", "role").agg(F.count(F.lit(1)).alias("n"))
