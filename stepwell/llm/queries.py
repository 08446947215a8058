"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers as tokenizers_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, chat, codec, fingerprint, langid, mpegts, neardup, packing, pii, quality, token_counts, urltree, wand
from .frames import documents, shared_dir


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], turns.schema)
    return chat.read_back(chat.windows(turns.unionByName(own), tokenizers_files.path("byte_bpe_50k.json")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.codec_digests(documents(spark, sf_dir), tokenizers_files.path("byte_bpe_50k.json"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizers_files.path("word_bpe_49k.json"))
    return packed.selectExpr("doc_id", "piece", "start", "cast(length as long) as length", "ids_crc32", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, cache = documents(spark, sf_dir), tokenizers_files.path("byte_bpe_50k.json"), shared_dir(spark, "token-counts")
    token_counts.token_counts(docs.where(F.crc32(F.col("doc_id").cast("string")) % 8 == 0), path, cache)  # as an earlier run would leave it
    return token_counts.token_counts(docs, path, cache)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(documents(spark, sf_dir))


def op7_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.read(mpegts.store(documents(spark, sf_dir)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The key of the surrogates; a deployment passes its own secret.
PII_KEY = "stepwell"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op11_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Every document scored for every item.
OP11_SQL = f"""
WITH found AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
counts AS (SELECT doc_id, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY term, n_docs),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS s FROM counts JOIN lengths USING (doc_id) JOIN weights USING (term), whole),
scores AS (SELECT item_id, doc_id, sum(times * s)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20"""


#: (verdict, host, path) of the rules (fixed values).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op13_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.clicks_to_orders(spark.read.parquet(f"{sf_dir}/clicks.parquet"), spark.read.parquet(f"{sf_dir}/sales.parquet"))


#: crc32 of an id's digits by its definition, then the collapsed orders met by DuckDB's own as-of join.
OP13_SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
numbered AS (
  SELECT click_id AS id, 1 AS side, max(client_id) AS client, max(epoch_us(ts)) AS us, NULL::INT AS priority, NULL::DOUBLE AS total FROM clicks GROUP BY click_id
  UNION ALL SELECT sale_id, 0, client_id, epoch_us(sold_at), priority, total FROM sales),
hashed AS (
  SELECT n.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM numbered n, tab),
timed AS (SELECT * REPLACE (CASE WHEN h % 2 = 1 THEN us - (us % 3600000000) ELSE us END AS us) FROM hashed),
orders AS (
  SELECT client, us, id AS sale, priority, total FROM timed WHERE side = 0
  UNION ALL SELECT client, us, -1 - id, 6 - priority, total FROM timed WHERE side = 0 AND h % 3 <> 0),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY client, us) AS tied,
         row_number() OVER (PARTITION BY client, us ORDER BY priority NULLS LAST, sale DESC NULLS LAST, floor(100 * total + 0.5) DESC NULLS LAST) AS r
  FROM orders WHERE client IS NOT NULL AND us IS NOT NULL),
winners AS (SELECT * FROM ranked WHERE r = 1),
met AS (
  SELECT c.id, c.client, c.us, w.us AS o_us, w.sale, w.total, w.tied, coalesce(c.us - w.us <= 240 * 3600000000, false) AS fits
  FROM (SELECT * FROM timed WHERE side = 1) c ASOF LEFT JOIN winners w ON c.client = w.client AND c.us >= w.us)
SELECT id AS click_id, client AS client_id, us AS ts_us, CASE WHEN fits THEN sale END AS sale_id, CASE WHEN fits THEN us - o_us END AS lag_us,
       CASE WHEN fits THEN floor(100 * total + 0.5)::BIGINT END AS total_cents, CASE WHEN fits THEN tied ELSE 0 END AS n_tied
FROM met"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op11_wand": OP11_SQL, "op13_asof": OP13_SQL}
