"""Numbers of rows and order of first sight that don't depend on how rows are dealt into partitions.

Numbers are given in two passes. Rows are dealt by ranges of their order, sorted in each, and written with their place in
their partition to the checkpoint folder, so a repeated task can't change them. The partitions' counts, one number each,
give the offsets. No task gets more than its range, unless one value of the whole order has more rows.

Nulls come first. Rows that are equal in the whole order may exchange their numbers. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a place in ``monotonically_increasing_id`` below those of the partition's number.
_PLACE = 33


def numbered(df: DataFrame, order: list[str | Column], name: str = "n", first: int = 0, parts: int | None = None) -> DataFrame:
    """With the rows' numbers in this order. Needs a checkpoint folder (``spark.checkpoint.dir``)."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", _PLACE)
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # over the partitions, not over the rows
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    place = F.col("__at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return rows.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__off") + place + first).drop("__at", "__part", "__off")


def first_sights(frames: list[tuple[DataFrame, list[str]]], keys: list[str]) -> DataFrame:
    """The distinct keys of some frames, one after another, each with the number of the frame (``source``, from 0) and the place in
    it (``seq``: the frame's own columns, of one type for all) of its first sight."""
    parts = [df.select(*keys, F.lit(i).alias("source"), F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(seq))).alias("seq")) for i, (df, seq) in enumerate(frames)]
    seen = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.min(F.struct("source", "seq")).alias("at"))
    return seen.select(*keys, "at.source", "at.seq")


def distinct_in_order(frames: list[tuple[DataFrame, list[str]]], keys: list[str]) -> DataFrame:
    """The distinct keys in the order of first sight."""
    return first_sights(frames, keys).orderBy("source", "seq").select(*keys)
