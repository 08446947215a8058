"""Token counts through a digest cache.

The cache is a Parquet table (digest, tokenizer, n_tokens). A text's digest is the sha256 of
its normalised content, so equal texts are encoded once, now and in later runs.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .frames import map_batches, shared_dir, text_or_empty

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names the version of a tokenizer: sha256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: str = "text"):
    """sha256 of the normalised content. The byte-level tokenizer distinguishes all bytes, so the
    only normalisation that keeps its counts is null to empty."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none where the folder doesn't exist yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def _count(texts: DataFrame, path: str) -> DataFrame:
    def run(batches):
        e = bpe.encoder(path)
        for batch in batches:
            some = batch.column(1).to_pylist()
            e.prime(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(e.count, some), pa.int64())], names=["digest", "n_tokens"])

    return map_batches(texts, run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``cache`` is a folder that grows with each call; without one, a new folder is used. Null
    texts count as empty (0 tokens). Only (key, digest) pairs are grouped, with a map-side
    minimum, to pick one row for each distinct miss; texts move once, spread by key, so that
    many copies of one text make no large task. Repeated rows are answered as often as they occur,
    an empty table gives an empty one, and columns of other names aren't read.
    """
    spark = docs.sparkSession
    cache, version = cache or shared_dir(spark, "token-counts"), tokenizer_digest(path)
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumn("digest", content_digest("_text"))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    one = rows.groupBy("digest").agg(F.min_by("_key", F.xxhash64("_key")).alias("_key"))
    misses = one.join(known, "digest", "left_anti") if not known.isEmpty() else one
    # a key may repeat with other texts, so the digest belongs to the join; copies of one row are counted once more below
    texts = rows.join(misses, [rows["_key"].eqNullSafe(misses["_key"]), rows["digest"] == misses["digest"]], "left_semi").select(rows["digest"], "_text")
    _count(texts, path).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")).select(
        "digest", F.lit(version).alias("tokenizer"), "n_tokens"
    ).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return (
        rows.select("_key", F.octet_length("_text").cast("long").alias("n_bytes"), "digest")
        .join(counts, "digest")
        .select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
