"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank - 1/2) / rows of its
source. In the order of fractional ranks every stretch holds the sources in the corpus' proportions, so equal cuts of
that order give shards that all match the mixture, with row counts at most one apart (law ``rows``).

Nulls: a null source is a source of its own; a null text has no bytes (its CRC is that of no bytes); null ids are rows
like others. Repeated rows are kept apart and each gets its own slot. An empty table gives an empty table. Columns that
aren't named are not read, so clashing names do no harm. Rows are ordered by hash, then id, CRC and size: only rows that are
equal in all of these can change places, and those of one source share a bucket of the hash. A text, however long, is only
measured and hashed where it is read. Equal texts may fall into different shards: with counts at
most one apart a group of copies larger than a shard can't stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import SEED, null_safe_key, partitions, ranked_within, written


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        null_safe_key(F.col(source_col)).alias("src"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "id", "crc"))
    # only ids and sizes move, never the texts; written once, since the cut needs both the counts and the rows
    ranked = written(ranked_within(rows, "src", "h", ["id", "crc", "size"], "rank", "total"), "ranked")
    buckets = 8 * partitions(spark)
    odd = F.col("rank") * 2 - 1
    ranked = ranked.withColumn("bucket", F.expr(f"(rank * 2 - 1) * {buckets} div (total * 2)").cast("int")).withColumn("at", odd / (F.col("total") * 2))
    # fractional ranks are uniform, so buckets are even whatever the sources' sizes; this table has one row per bucket
    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"), F.sum("n").over(W.partitionBy()).alias("all"))
    inside = W.partitionBy("bucket").orderBy("at", "src", "rank")
    placed = ranked.join(offsets, "bucket").withColumn("pos", F.col("off") + F.row_number().over(inside) - 1)
    k = F.expr(f"pos * {shards} div all")
    return placed.withColumn("shard", k.cast("int")).select(
        F.col("id"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("pos") - F.expr(f"(shard * all + {shards - 1}) div {shards}")).cast("long").alias("slot"), F.col("src").alias("source_key")
    )
