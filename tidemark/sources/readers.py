"""Readers for the file kinds that records come in. All are lazy; paths are Spark's (any store it can read)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, as_text: bool = False) -> DataFrame:
    """A CSV with a header: with a schema, all as text, or with inferred types."""
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", not as_text).csv(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    """JSON Lines; blank lines are skipped, unreadable ones have their text in _corrupt_record. Records with different keys
    are one frame with all keys."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A JSON file that is a list of records or one record."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def excel(spark: SparkSession, path: str) -> DataFrame:
    """A sheet, read on the driver (sheets are small); needs pandas' Excel support."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading Excel needs openpyxl, which isn't installed") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store Spark finds it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def load_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None, as_text: bool = False) -> DataFrame:
    """By suffix: .jsonl, .json, .csv, .parquet, .xlsx. A missing path is an error. ``as_text``: a CSV's columns all as text."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix in ("jsonl", "ndjson"):
        return json_lines(spark, path, schema)
    if suffix == "json":
        return json_document(spark, path, schema)
    if suffix == "parquet":
        return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    if suffix in ("xlsx", "xls"):
        return excel(spark, path)
    if suffix in ("csv", "txt"):
        return csv(spark, path, schema, as_text)
    raise ValueError(f"no reader for {path}")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file, or an empty frame with the schema where there is none. A file that can't be read is an error."""
    return load_any(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """The wanted columns that the header has; others are never read."""
    return df.select(*(c for c in names if c in df.columns))


def named_files(spark: SparkSession, paths: list[str], schema: str, pattern: str = r"features_(.+)\.csv$", column: str = "feature", manifest: list[str] | None = None) -> DataFrame:
    """Many CSV files as one frame with a name from each file's name; with a manifest only files of those names."""
    df = spark.read.options(header=True).schema(schema).csv(paths).withColumn(column, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)).where(F.col(column) != "")
    return df.where(F.col(column).isin(*manifest)) if manifest is not None else df


def config(spark: SparkSession, path: str) -> dict:
    """A small YAML or JSON settings file, from any store that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        import json

        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML, which isn't installed") from e
    return yaml.safe_load(text) or {}


def seeds(spark: SparkSession, ids: dict[str, list[str]]) -> DataFrame:
    """(store, id) rows from lists of ids."""
    return spark.createDataFrame([(s, i) for s, xs in ids.items() for i in xs], "store string, id string")


def reviews(spark: SparkSession, main: str, fallback: str, schema: str, platform: str) -> DataFrame:
    """The main review table, else the fallback, with its platform."""
    path = main if exists(spark, main) else fallback
    return optional(spark, path, schema).withColumn("platform", F.lit(platform))
