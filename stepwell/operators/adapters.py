"""Source rows made into questions, units, targets and samples, with what they must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Fixed value: the name of the question set.
DATASET = "hotpotqa_distractor"


def required(value: Column, name: str) -> Column:
    """The trimmed text of a field; a row without it is an error."""
    text = F.trim(value.cast("string"))
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.raise_error(F.concat(F.lit(f"field {name} is missing or empty"))).cast("string"))


def project(rows: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """qid and a fixed list of fields; a field that the table lacks, or a row without an id, is an error."""
    if lacking := [f for f in (id_, *fields) if f not in rows.columns]:
        raise ValueError(f"fields are missing: {', '.join(lacking)}")
    return rows.select(required(F.col(id_), id_).alias("qid"), *fields)


def query_records(rows: DataFrame, split: str, dataset: str = DATASET) -> DataFrame:
    """(qid, question, answer, metadata) of rows with type and level."""
    kind = lambda c: F.trim(F.col(c).cast("string")).alias(c)
    meta = F.struct(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), kind("type"), kind("level"))
    return rows.select(*(required(F.col(c), c).alias(c) for c in ("qid", "question", "answer")), meta.alias("metadata"))


def chained_rows(rows: DataFrame) -> DataFrame:
    """(qid, question, answer, aliases, paragraphs, support_order, problem) of questions with a decomposition.

    ``rows``: qid, question, answer, answerable, paragraphs (idx, title, text, supporting),
    decomposition (paragraph numbers), aliases. ``problem`` names the first rule a row breaks
    and is null for a usable one.
    """
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    idx = F.transform("paragraphs", lambda p: p["idx"])
    support = F.transform(F.filter("paragraphs", lambda p: F.coalesce(p["supporting"], F.lit(False))), lambda p: p["idx"])
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rules = [
        ((trim(F.col("qid")) == "") | (trim(F.col("question")) == "") | (trim(F.col("answer")) == "") | ~F.coalesce("answerable", F.lit(True)), "incomplete"),
        (size("paragraphs") <= 0, "no paragraphs"), (size("decomposition") <= 0, "no decomposition"), (F.size(idx) != F.size(F.array_distinct(idx)), "repeated paragraph"),
        (F.exists("paragraphs", lambda p: trim(p["text"]) == ""), "empty paragraph"), (F.size(F.array_except("decomposition", idx)) > 0, "absent support"),
        (F.size("decomposition") != F.size(F.array_distinct("decomposition")), "support not one to one"), ((F.size(F.array_except("decomposition", support)) > 0) | (F.size(F.array_except(support, "decomposition")) > 0), "support differs from flags"),
    ]
    problem = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules))
    titled = F.transform(F.array_sort("paragraphs", lambda a, b: a["idx"] - b["idx"]), lambda p: F.struct(p["idx"].alias("idx"), F.coalesce(F.nullif(trim(p["title"]), F.lit("")), F.concat(F.lit("paragraph_"), p["idx"].cast("string"))).alias("title"), trim(p["text"]).alias("text"), F.coalesce(p["supporting"], F.lit(False)).alias("supporting")))
    answer = trim(F.col("answer"))
    aliases = F.array_distinct(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), trim), lambda a: (a != "") & (a != answer)))
    return rows.select(trim(F.col("qid")).alias("qid"), trim(F.col("question")).alias("question"), answer.alias("answer"), aliases.alias("aliases"), titled.alias("paragraphs"), F.col("decomposition").alias("support_order"), problem.alias("problem"))


def evaluation_set(rows: DataFrame) -> dict[str, DataFrame]:
    """queries, raw_units, targets and samples of usable rows as by `chained_rows`.

    A unit is a paragraph, ``qid::idx``. A sample is a step: its gold unit, the gold units before
    it as context, and all of the question's units not used yet as candidates.
    """
    good = rows.where("problem is null") if "problem" in rows.columns else rows
    each = good.select("qid", F.explode("paragraphs").alias("p")).select("qid", F.concat_ws("::", "qid", F.col("p.idx").cast("string")).alias("unit_id"), F.col("p.title").alias("doc_id"), F.col("p.text").alias("text"), F.col("p.idx").alias("idx"))
    order = good.select("qid", F.posexplode("support_order").alias("t", "idx"))
    targets = order.select("qid", "t", F.concat_ws("::", "qid", F.col("idx").cast("string")).alias("unit_id"))
    units = good.select("qid", F.transform("paragraphs", lambda p: F.concat_ws("::", F.col("qid"), p["idx"].cast("string"))).alias("all"), F.transform("support_order", lambda i: F.concat_ws("::", F.col("qid"), i.cast("string"))).alias("gold"))
    samples = units.select("qid", F.posexplode("gold").alias("t", "positive"), "gold", "all")
    before = F.slice("gold", F.lit(1), F.col("t"))
    samples = samples.select("qid", "t", "positive", before.alias("context"), F.array_except("all", before).alias("candidates"))
    return {"queries": good.select("qid", "question", "answer", "aliases"), "raw_units": each, "targets": targets, "samples": samples}


def grouped_join(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Each question with the rows of its own index (both by qid): an equi-join, so a question's documents never leave its group."""
    return questions.join(index, "qid")


def forbidden_paths(schema: StructType, forbidden: set[str], path: str = "$") -> list[str]:
    """Where a schema has a field of a forbidden name, at any depth; read off the schema, not the rows."""
    out = []
    for f in schema.fields:
        here, kind = f"{path}.{f.name}", f.dataType
        out += [here] if f.name in forbidden else []
        while isinstance(kind, (ArrayType, MapType)):
            here += "[]"
            kind = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
        if isinstance(kind, StructType):
            out += forbidden_paths(kind, forbidden, here)
    return out


def forbidden_rows(rows: DataFrame, column: str, forbidden: list[str]) -> DataFrame:
    """The rows whose JSON text in ``column`` has a forbidden key at any depth."""
    keys = "|".join(f"\\Q{k}\\E" for k in forbidden)
    return rows.where(F.col(column).rlike(f'"(?:{keys})"\\s*:'))


def carried(frames: dict[str, DataFrame], changed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a derived version: the changed ones, and the others as they are, without a copy."""
    return {**frames, **changed}


def consolidated_notes(notes: DataFrame) -> DataFrame:
    """One row for each note (qid, note_id) over all steps, with its place by (priority, id); different payloads of one id are an error.

    ``notes``: qid, t, note_id, type, text, sources, priority.
    """
    payload = F.struct("type", "text", "sources")
    per = notes.groupBy("qid", "note_id").agg(F.min(payload).alias("p"), F.max(payload).alias("q"), F.min("priority").alias("priority"), F.min("t").alias("t"))
    same = F.when(F.col("p") == F.col("q"), F.col("p.type")).otherwise(F.raise_error(F.concat(F.lit("different notes of one id: "), F.col("note_id"))).cast("string"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("priority", F.lit(10**9)), "note_id"))
    return per.select("qid", "note_id", same.alias("type"), "p.text", "p.sources", "priority", "t", place.alias("place"))
