"""Shared pieces: the folder all executors see, written cut points, and grouped streaming inside a task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 20240607


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only a local master may do without it, with a folder of its own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and any executor can be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of frames from ``written`` that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["written_to"]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch, for every operator: a plan may run long after it was made, so the setting stays.
BATCH = 1000


def tuned(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers, so that long texts don't pile up in one batch. A session that has
    smaller ones keeps them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def null_safe_key(c: Column) -> Column:
    """A string that tells a null from any text, for joins and groups."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


#: Bytes of the keys and values of a side that may be broadcast; in memory it takes a few times as many.
BROADCAST = 8 << 20
_WIDTHS = {"boolean": 1, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}


def small_enough(df: DataFrame, most: int = BROADCAST) -> bool:
    """Whether a written table has at most ``most`` bytes, by its own count and the measured sizes of its texts and binaries."""
    fixed = 16 + sum(_WIDTHS.get(t, 256 if t.startswith("array") else 8) for _, t in df.dtypes)
    free = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(free, F.lit(0))), F.lit(0)).alias("b")).first()
    return got["n"] * fixed + got["b"] <= most


def sized_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST) -> DataFrame:
    """Join with a written table: broadcast if it is measured to have at most ``most`` bytes, else a shuffle join that AQE may split."""
    return left.join(F.broadcast(small) if small_enough(small, most) else small, on, how)


#: Two hashes of a whole row, which name it in a table where ids may repeat or be null.
ROW_KEY = ["__k1", "__k2"]


def keyed(df: DataFrame) -> DataFrame:
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumns({"__k1": F.xxhash64(F.lit(1), *cols), "__k2": F.xxhash64(F.lit(2), *cols)})


def without(df: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """The rows of a keyed frame but the rejected ones, without the keys."""
    keys = written(rejected.select(*ROW_KEY).distinct(), name)
    return sized_join(df, keys, ROW_KEY, "left_anti").drop(*ROW_KEY)


def hash_bucket(h: Column, n: int) -> Column:
    """The bucket (0 to n-1) of a 64-bit hash by its high bits, so that buckets keep the hash's order."""
    return F.shiftright(F.shiftrightunsigned(h, 40) * F.lit(n), 24).cast("int")


def ranked_within(df: DataFrame, key: str, h: str, ties: list[str], rank: str, total: str) -> DataFrame:
    """Add the rank (from 1) of each row within its key by hash ``h``, and the key's row count.

    A key may hold a third of all rows, so no task ever gets a whole key: rows are ranked within (key, bucket of
    the hash) and the buckets' offsets come from a pre-aggregated count table.
    """
    n = 8 * partitions(df.sparkSession)
    df = df.withColumn("__b", hash_bucket(F.col(h), n))
    from pyspark.sql import Window as W

    counts = df.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    own = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(key)
    counts = counts.select(key, "__b", F.coalesce(F.sum("__n").over(own), F.lit(0)).alias("__off"), F.sum("__n").over(whole).alias(total))
    inside = W.partitionBy(key, "__b").orderBy(h, *ties)
    out = df.join(counts, [key, "__b"]).withColumn(rank, F.col("__off") + F.row_number().over(inside))
    return out.drop("__b", "__off")


def slices(frames: Iterable[pd.DataFrame], column: str, limit: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that each holds about ``limit`` characters of ``column`` (one longer text stands alone)."""
    for f in frames:
        if not len(f):
            continue
        size = f[column].map(lambda t: len(t) if t is not None else 0).cumsum().to_numpy()
        part = size // limit
        at = 0
        while at < len(f):
            end = at + int((part[at:] == part[at]).sum())
            yield f.iloc[at:end].reset_index(drop=True)
            at = end


def runs(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream that is sorted by ``keys``; a group may span batches, and one group is held at a time."""
    held: pd.DataFrame | None = None
    for f in frames:
        if not len(f):
            continue
        if held is not None:
            f = pd.concat([held, f], ignore_index=True)
        change = (f[keys] != f[keys].shift()).any(axis=1).to_numpy()
        starts = [i for i, c in enumerate(change) if c]
        for a, b in zip(starts, starts[1:]):
            yield f.iloc[a:b]
        held = f.iloc[starts[-1] :]
    if held is not None and len(held):
        yield held
