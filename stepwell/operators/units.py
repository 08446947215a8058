"""From documents to sentence units, chunks and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def units(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each non-empty sentence: unit_id (``doc::sent``), doc, sent_id, text. sent_id keeps the position."""
    cut = docs.select(F.col(doc).alias("doc"), F.posexplode(T.sentences(F.col(text))).alias("sent_id", "text"))
    return cut.select(F.concat_ws("::", F.col("doc").cast("string"), F.col("sent_id").cast("string")).alias("unit_id"), "doc", "sent_id", "text")


def context_units(samples: DataFrame) -> DataFrame:
    """Units of (qid, context array<struct<title, sentences>>): unit_id ``qid::title::sent``."""
    titled = samples.select("qid", F.explode("context").alias("c"))
    cut = titled.select("qid", F.col("c.title").alias("title"), F.posexplode("c.sentences").alias("sent_id", "text"))
    kept = cut.withColumn("text", F.trim("text")).where("text <> ''")
    return kept.select(F.concat_ws("::", "qid", "title", F.col("sent_id").cast("string")).alias("unit_id"), "qid", "title", "sent_id", "text")


def with_support(unit_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``unit_rows`` with is_supporting: whether (qid, title, sent_id) is among the facts."""
    marked = facts.select("qid", "title", "sent_id").distinct().withColumn("is_supporting", F.lit(True))
    return unit_rows.join(marked, ["qid", "title", "sent_id"], "left").withColumn("is_supporting", F.coalesce("is_supporting", F.lit(False)))


def unresolved_facts(unit_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that no unit matches."""
    return facts.join(unit_rows, ["qid", "title", "sent_id"], "left_anti")


def normalize_facts(facts: Column) -> Column:
    """Columnar ``{title[], sent_id[]}`` to an array of distinct (title, sent_id)."""
    return F.array_distinct(F.arrays_zip(facts["title"], facts["sent_id"]))


def normalize_context(context: Column) -> Column:
    """Columnar ``{title[], sentences[][]}`` to an array of (title, sentences)."""
    return F.arrays_zip(context["title"], context["sentences"])


def chunks(docs: DataFrame, summary_sentences: int = 2, summary_chars: int = 200) -> DataFrame:
    """A chunk for each document: its text and a summary of its first sentences."""
    summary = F.array_join(F.slice(T.sentences(F.col("text")), 1, summary_sentences), " ")
    return docs.select("doc_id", F.col("text").alias("chunk_text"), T.shorten(summary, summary_chars).alias("summary_text"))


def chunk_id(doc: Column, text: Column) -> Column:
    """``rawchunk::`` and the sha1 of the sorted-key JSON of text and document, spaces squeezed."""
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.concat(F.lit("rawchunk::"), F.sha1(F.to_json(F.struct(squeezed.alias("chunk_text"), doc.cast("string").alias("doc_id")))))


def retrieval_text(title: Column, text: Column) -> Column:
    return F.concat_ws(" [SEP] ", title, text)


def candidate_text(title: Column, sent_id: Column, text: Column) -> Column:
    return F.concat(title, F.lit(" ["), sent_id.cast("string"), F.lit("] "), text)


def provenance(rows: DataFrame, registry: DataFrame, key: str = "unit_id") -> DataFrame:
    """``rows`` with the registry's columns for their unit; Catalyst broadcasts the registry when it is small."""
    return rows.join(registry, key, "left")


def valid_reason(question: Column, answer: Column, facts: Column, resolved: Column, distractors: Column) -> Column:
    """Why a sample is rejected, '' if it isn't."""
    return (
        F.when(F.coalesce(F.trim(question), F.lit("")) == "", "missing_question")
        .when(F.coalesce(F.trim(answer), F.lit("")) == "", "missing_answer")
        .when(facts == 0, "no_facts")
        .when(resolved < facts, "unresolved_fact")
        .when(distractors == 0, "no_distractor")
        .otherwise("")
    )
