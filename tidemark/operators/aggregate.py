"""Roll-ups, pivots, frequencies, agreement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import weighted_mean


def sentiment_by_app(df: DataFrame, keys: list[str], neutral: str | None = None) -> DataFrame:
    """Per key: reviews, flagged ones, mean rating and score, shares of positive and negative scores. Null keys stay."""
    rows = df.where(F.col("sentiment_label") != neutral) if neutral else df
    share = lambda label: F.avg((F.col("sentiment_label") == label).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.coalesce(F.col("special_reviews"), F.lit(False))).alias("n_nd"), F.avg("rating").alias("avg_rating"),
        F.avg("sentiment_score").alias("mean_compound"), share("positive").alias("pct_positive"), share("negative").alias("pct_negative"),
    )


def weighted_rollup(df: DataFrame, keys: list[str], weight: str, means: list[str], sums: list[str]) -> DataFrame:
    """Sums, and means weighted by ``weight``."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(weighted_mean(F.col(c), F.col(weight)).alias(c) for c in means))


def plain_rollup(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Plain means of all columns."""
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns))


def matrix(df: DataFrame, key: str, by: str, value: str, how: str, names: list[str], fill: object = 0) -> DataFrame:
    """A row per key and a column per name, in the names' order; given names save Spark the job that finds them."""
    agg = {"max": F.max, "sum": F.sum}[how](value)
    return df.groupBy(key).pivot(by, sorted(names)).agg(agg).fillna(fill)


def class_counts(df: DataFrame, keys: list[str], column: str, classes: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(column) == v).alias(name) for name, v in classes.items()))


def top_items(df: DataFrame, keys: list[str], items: Column, seq: list[str], n: int = 8, out: str = "top_items", sep: str = "; ") -> DataFrame:
    """The ``n`` most frequent list items of each key, joined; ties in order of first occurrence."""
    each = df.select(*keys, F.struct(*seq).alias("__s"), F.posexplode(items).alias("__p", "item"))
    freq = each.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__s", "__p")).alias("first"))
    ranked = freq.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first"))).where(F.col("r") <= n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"])  # n items at most
    return ranked.groupBy(*keys).agg(F.array_join(ordered, sep).alias(out))


def taxonomy_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct("feature_name").alias("features"), F.avg("support_val").alias("mean_support"), F.avg(F.col("nd_specific").cast("double")).alias("share_nd_specific"))


def kappa(n: Column, ones_a: Column, ones_b: Column, both: Column) -> Column:
    """Cohen's kappa of two 0/1 ratings from counts: of items, of each one's ones, of items where both are one. Null where chance
    agreement is complete."""
    agree = 1 - (ones_a + ones_b - 2 * both) / n
    pa, pb = ones_a / n, ones_b / n
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.round(F.when(chance < 1, F.try_divide(agree - chance, 1 - chance)), 3)


def _marks(ratings: DataFrame, items: list[str], rater: str, value: str) -> DataFrame:
    """A row for each rater and item: whether any of the ratings is one. ``__item`` is a digest of the item, nulls apart."""
    item = F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in items)), F.hash(*(F.struct(F.col(c).isNull(), F.col(c)) for c in items))
    rows = ratings.select(F.struct(item[0].alias("h"), item[1].alias("g")).alias("__item"), F.col(rater).cast("string").alias("rater"), F.col(value).alias("v"))
    return rows.groupBy("__item", "rater").agg(F.coalesce(F.max("v"), F.lit(0)).cast("int").alias("one"))


def human_agreement(ratings: DataFrame, human: DataFrame, items: list[str], rater: str, value: str) -> DataFrame:
    """Kappa and number of items of each rater against the human labels (column ``value``), over the items that have both a
    rating by anyone and a human label; an item that this rater didn't label counts as 0. Ratings are 0 or 1."""
    marks = _marks(ratings, items, rater, value)
    label = _marks(human.where(F.col(value).isNotNull()).withColumn("__rater", F.lit("human")), items, "__rater", value).select("__item", F.col("one").alias("human"))
    both = marks.join(label, "__item")
    whole = both.groupBy("__item").agg(F.first("human").alias("human")).agg(F.count(F.lit(1)).alias("n"), F.sum("human").alias("ones_b"))  # one row
    each = both.where("rater is not null").groupBy("rater").agg(F.sum("one").alias("ones_a"), F.sum(F.col("one") * F.col("human")).alias("both"))
    # raters without an item that has a label are compared, too
    each = marks.where("rater is not null").select("rater").distinct().join(each, "rater", "left").na.fill(0)
    got = each.crossJoin(F.broadcast(whole)).where("n > 0")
    return got.select(F.col("rater").alias("rater_a"), F.lit("human").alias("rater_b"), kappa(*map(F.col, ("n", "ones_a", "ones_b", "both"))).alias("kappa"), "n")


#: Raters of a block: a task holds the counts of one pair of blocks.
RATER_BLOCK = 1000


def _together(marks: DataFrame, own: DataFrame, block: int) -> DataFrame:
    """(rater_a, rater_b, both): items where both gave a one, for the pairs that have any; a < b. Items' raters become 0/1 rows,
    and the products of such rows are added up in the task, so no pair of one item is ever a row."""
    blocks = own.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    ones = marks.where("one = 1 and rater is not null").groupBy("__item").agg(F.collect_list("rater").alias("raters"))  # a rater is there once
    ones = ones.crossJoin(F.broadcast(blocks))
    of = "map_from_entries(transform(sequence(0, blocks - 1), x -> struct(x, filter(raters, r -> pmod(xxhash64(r), blocks) = x))))"
    sides = ones.withColumn("of", F.when(F.col("blocks") == 1, F.expr("map(0, raters)")).otherwise(F.expr(of)))
    pairs = sides.select("__item", "of", F.explode(F.expr("flatten(transform(sequence(0, blocks - 1), x -> transform(sequence(x, blocks - 1), y -> named_struct('lo', x, 'hi', y))))")).alias("p"))
    rows = pairs.select(F.pmod("__item.g", F.lit(64)).alias("part"), "p.lo", "p.hi", F.element_at("of", F.col("p.lo")).alias("x"), F.when(F.col("p.lo") < F.col("p.hi"), F.element_at("of", F.col("p.hi"))).alias("y"))
    rows = rows.repartition("lo", "hi", "part").sortWithinPartitions("lo", "hi")  # a block pair has 64 tasks at most

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counts, left, right = None, None, {}, {}

        def flushed() -> Iterator[pd.DataFrame]:
            if key is not None:
                a, b = np.array(list(left), object), np.array(list(right), object)
                i, j = np.nonzero(counts[: len(a), : len(b)])
                x, y, n = a[i], b[j], counts[i, j]
                swap = x > y
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                keep = (x != y) & ~(swap if key[0] == key[1] else np.zeros(len(x), bool))  # one block has each pair both ways
                yield pd.DataFrame({"rater_a": x[keep], "rater_b": y[keep], "both": n[keep]})

        def numbers(of: dict, found: list) -> np.ndarray:
            return np.fromiter((of.setdefault(r, len(of)) for r in found), np.int64, len(found))

        for f in frames:
            for lo, hi, x, y in zip(f["lo"], f["hi"], f["x"], f["y"]):
                if not len(x) or (lo != hi and not len(y)):
                    continue
                if (lo, hi) != key:
                    yield from flushed()
                    key, counts, left, right = (lo, hi), np.zeros((64, 64), np.int64), {}, {}
                    if lo == hi:
                        right = left
                i = numbers(left, list(x))
                j = i if lo == hi else numbers(right, list(y))
                need = max(len(left), len(right))
                if need > len(counts):
                    more = np.zeros((2 * need, 2 * need), np.int64)
                    more[: len(counts), : len(counts)] = counts
                    counts = more
                counts[i[:, None], j] += 1  # an item has a rater once
        yield from flushed()

    return rows.mapInPandas(added, "rater_a string, rater_b string, both long").groupBy("rater_a", "rater_b").agg(F.sum("both").alias("both"))


def rater_agreement(ratings: DataFrame, items: list[str], rater: str, value: str, block: int = RATER_BLOCK) -> DataFrame:
    """Kappa and number of items for every pair of raters; an item that a rater didn't label counts as 0. Ratings are 0 or 1.

    Any number of raters: what two of them have in common is counted sparsely, from the items that have ones of both. Every
    pair of raters is a row of the result, and nothing else is as large.
    """
    marks = _marks(ratings, items, rater, value)
    if ratings.sparkSession.sparkContext.getCheckpointDir():  # they are read several times; without a folder they are made again
        marks = marks.checkpoint()
    whole = marks.select("__item").distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    own = marks.where("rater is not null").groupBy("rater").agg(F.sum("one").alias("ones"))
    a, b = (own.select(F.col("rater").alias(f"rater_{x}"), F.col("ones").alias(f"ones_{x}")) for x in "ab")
    pairs = a.join(b, F.col("rater_a") < F.col("rater_b")).join(_together(marks, own, block), ["rater_a", "rater_b"], "left").na.fill(0, ["both"])
    got = pairs.crossJoin(F.broadcast(whole))
    return got.select("rater_a", "rater_b", kappa(*map(F.col, ("n", "ones_a", "ones_b", "both"))).alias("kappa"), "n")


def shares(df: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Counts of each class and their share of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(W.partitionBy())  # over the few classes, not over the rows
    return counts.select(*keys, "n", F.round(F.col("n") / whole, digits).alias("share"))


def frequencies(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """How often each item stands in the lists. Lists are made once: before a plain ``explode`` Spark asks for lists that aren't
    empty, and makes each of them again for that."""
    each = df.select(F.posexplode_outer(items).alias("__p", name)).where("__p is not null")  # null for a list without items
    return each.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def word_frequencies(df: DataFrame, text: Column, stop: list[str] = (), least: int = 3) -> DataFrame:
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"[a-zA-Z]{{{least},}}"), F.lit(0))
    out = frequencies(df, found, "word")
    return out.where(~F.col("word").isin(*stop)) if stop else out


def joined_texts(df: DataFrame, keys: list[str], text: str, seq: str, sep: str = " ", first: int | None = None) -> DataFrame:
    """The texts of each key in order, nulls skipped; ``first`` limits them before they are gathered. Without it a key's texts
    are one value, however many: only for keys that are known to be small."""
    rows = df.where(F.col(text).isNotNull())
    if first:
        rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(seq))).where(F.col("__r") <= first)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), sep).alias("texts"))
