"""JSON lines and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One row for each non-blank line. Strict reading fails on a bad line; else it stands in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Writes compact lines and returns their number, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def read_document(spark: SparkSession, path: str, row_schema: str, keys: tuple[str, ...] = ("records", "results")) -> DataFrame:
    """Rows of whole-file JSON: an array, or an object that holds them under one of ``keys``."""
    whole = spark.read.text(path, wholetext=True)
    under = [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{row_schema}>>") for k in keys]
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{row_schema}>>"))
    return whole.select(F.explode(F.coalesce(listed, *under)).alias("r")).select("r.*")


def read_local(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """JSON lines by suffix, else a document in any of the usual layouts."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, row_schema)
    return read_document(spark, path, row_schema, ("data", "examples", "validation", "dev", "test", "train", "records", "results"))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A summary of few rows as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A long metric table with a header, tab separated."""
    df.coalesce(1).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def alias_path(*columns: Column) -> Column:
    """The first alternative that is present."""
    return F.coalesce(*columns)


def lenient_bool(x: Column) -> Column:
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False)


def load_config(path: str) -> dict:
    """A YAML file where a YAML reader is installed, else JSON."""
    with open(path, encoding="utf-8") as f:
        try:
            import yaml

            return yaml.safe_load(f)
        except ImportError:
            import json

            return json.load(f)


def flatten_config(value: dict, prefix: str = "") -> dict:
    """Dotted keys to leaves."""
    out = {}
    for k, v in value.items():
        out |= flatten_config(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def config_differences(a: dict, b: dict, allowed: set[str] = frozenset()) -> dict:
    x, y = flatten_config(a), flatten_config(b)
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k) and k not in allowed}
