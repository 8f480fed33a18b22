"""Writers. Parquet between steps; CSV and JSON at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import matrix
from ..operators.gates import split


def overwrite(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Appended files; every CSV file has its own header, which readers know."""
    w = df.write.mode("append")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """A table of so many files a task, dealt by the hash of its keys and sorted by them. Tables that are bucketed alike are grouped
    and joined by these keys (and by more) without moving a row; see ``without_exchange``."""
    w = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(name)
    return df.sparkSession.table(name)


def without_exchange(spark: SparkSession) -> None:
    """Let Spark use a table's buckets wherever they suffice: also for joins on more than the bucket keys, and however small the
    buckets are compared to its own estimate."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flat_lists(df: DataFrame, sep: str = ",") -> DataFrame:
    """Lists as delimited text, for CSV."""
    return df.select(*(F.array_join(c, sep).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes))


def split_tables(df: DataFrame, kept: str, dropped: str, reason: str = "drop_reason") -> None:
    """One frame with reasons as two tables; it is computed once."""
    df = df.persist()
    try:
        for part, path in zip(split(df, reason), (kept, dropped)):
            overwrite(part, path)
    finally:
        df.unpersist()


def matrices(long: DataFrame, folder: str, features: list[str]) -> None:
    """The long table and its three matrices: flags, confidence, review hits."""
    overwrite(long, f"{folder}/features_long")
    for value, how, fill in (("flag", "max", 0), ("confidence", "max", 0.0), ("review_hits", "sum", 0)):
        overwrite(matrix(long, "app_key", "feature", value, how, features, fill), f"{folder}/features_matrix_{value}")
