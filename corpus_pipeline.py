"""A corpus pipeline: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. A stage
defines its result for nulls, empty texts and repeated rows as the operator it calls does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import langid, neardup, packing, pii, quality
from stepwell.llm.frames import remove, shared_dir
from stepwell.llm.queries import PII_KEY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts, texts without letters, and texts unlike all of the learnt languages."""
    return langid.identify(docs, langid.learn(docs)).where("not rejected").select(docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier predicts as 0."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near-duplicates the document of least doc_id."""
    return neardup.representatives(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text."""
    return pii.pseudonymise(docs, PII_KEY).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.selectExpr("doc_id", "piece", "start", "cast(length as long) as length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("quality", good), ("neardup", unique), ("pii", private), ("packing", packed)]
#: The classifiers and the packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
