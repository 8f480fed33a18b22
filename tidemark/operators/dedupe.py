"""Which row of a key stays. Every choice has an explicit order; windows are by the key, or by (key, hash) first where a
key may be huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import review_hash, text_or_blank


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in this order. Spark limits each key before the shuffle, so hot keys are small."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_latest(df: DataFrame, keys: list[str], time: str, count: str, seq: list[Column], nulls: str = "win") -> DataFrame:
    """The row with the latest time, then the highest count. Rows without a time win by default, as they would if sorted
    last; ``nulls="lose"`` turns that round."""
    first = nulls == "win"
    order = [F.col(c).desc_nulls_first() if first else F.col(c).desc_nulls_last() for c in (time, count)]
    return top_rows(df, keys, [*order, *seq])


def keep_first(df: DataFrame, keys: list[str], seq: list[Column]) -> DataFrame:
    return top_rows(df, keys, seq)


def keep_last(df: DataFrame, keys: list[str], seq_desc: list[Column]) -> DataFrame:
    return top_rows(df, keys, seq_desc)


def first_by_id(df: DataFrame, keys: list[str], review_id: str, seq: list[Column]) -> DataFrame:
    """The first row of each id within the keys; rows with a blank id all stay."""
    blank = F.coalesce(F.trim(F.col(review_id).cast("string")), F.lit("")) == ""
    named = top_rows(df.where(~blank), [*keys, review_id], seq)
    return named.unionByName(df.where(blank))


def best_by_text(df: DataFrame, key: str, body: str, time: str, seq: list[Column], hash_col: str = "text_hash") -> DataFrame:
    """Of reviews with one text: dated ones before undated, newer before older, undated longer before shorter, then the
    first."""
    rows = df.withColumn(hash_col, review_hash(F.col(key), F.col(body)))
    size = F.when(F.col(time).isNull(), F.length(body))
    return top_rows(rows, [hash_col], [F.col(time).desc_nulls_last(), size.desc_nulls_last(), *seq])


def best_per_text(df: DataFrame, key: str, body: str, time: str, seq: str, carry: list[str]) -> DataFrame:
    """As ``best_by_text``, but one aggregate that moves no texts: text_hash, the best row's ``carry``, and n, the number of
    rows of that text. ``seq`` is a number; the least is the first."""
    rows = df.select(review_hash(F.col(key), F.col(body)).alias("text_hash"), F.col(time).alias("__t"), F.when(F.col(time).isNull(), F.length(text_or_blank(F.col(body)))).alias("__n"), (-F.col(seq)).alias("__s"), F.struct(*carry).alias("__c"))
    got = rows.groupBy("text_hash").agg(F.max_by("__c", F.struct(F.col("__t").isNotNull(), "__t", "__n", "__s")).alias("c"), F.count(F.lit(1)).alias("n"))
    return got.select("text_hash", "c.*", "n")


def first_distinct(df: DataFrame, long_keys: list[str], keys: list[str], seq: str) -> DataFrame:
    """The least ``seq`` of each distinct combination, long texts being told apart by 128-bit digests, so that none is moved."""
    digests = [F.md5(F.encode(F.col(c).cast("string"), "UTF-8")).alias(f"__{i}") for i, c in enumerate(long_keys)]
    return df.select(*digests, *keys, seq).groupBy(*(f"__{i}" for i in range(len(long_keys))), *keys).agg(F.min(seq).alias(seq)).select(seq)
