"""Quality rules: base statistics of whole texts, then robust multivariate outliers.

Each document gets a vector of transformed statistics. For each group (language and source) the location and scatter
of these vectors are estimated by the minimum covariance determinant: concentration steps over *all* rows of the
group, each step a pre-aggregated sum per group, so that a group with a third of all rows is never in one task. A
document is rejected if the Mahalanobis distance of its vector to its group is too large.

Vectors are rounded to integers (``UNIT`` parts of one), so that sums, and with them the verdicts, don't depend on the order
in which rows are added. Groups of fewer than ``min_group`` documents that pass the base rules are pooled by language, and pools
as small as that into one.

Nulls: a null text has no words and fails the base rules; null languages and sources are groups of their own; rows with
null or repeated ids are judged like others. An empty table gives an empty table. Texts are read in slices of about two
million characters; a longer text is held whole, with about 15 times its bytes, by the task that reads it. Equal vectors
get equal verdicts, ties included. Columns that aren't named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import null_safe_key, sized_join, slices, tuned, written
from .textnp import windows, word_hashes, words

UNIT = 1024
#: The transformed statistics: log of the mean word length, and square roots of shares per word.
FEATURES = ("x0", "x1", "x2", "x3")
#: Least standard deviation of each, so that a constant statistic of a group doesn't reject the first deviating document. Both
#: shares have room to be rejected alone: from a centre at 0, 87.5 % duplicate lines or 43.4 % repeated words are too much.
FLOOR = np.array([0.06, 0.05, 0.135, 0.095])
#: Upper point of chi-square with four degrees of freedom that normal data pass but for one in 10^9.
CUTOFF = 48.0
#: Scatter of normal data in four dimensions over that of its inner three quarters.
CONSISTENCY = 1.5
SYMBOLS = b"#*$%&|<>"
STATS = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_stats(texts: list[str | None]) -> pd.DataFrame:
    """The base statistics of each text; all zero for null and empty texts."""
    w = words(texts)
    h = word_hashes(w)
    n = w.counts
    window, at = windows(w, h, 3)
    doc = w.doc[at]
    order = np.lexsort((window, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (window[order][1:] == window[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marked = np.zeros(len(h), bool)
    for j in range(3):
        marked[at[order[twice]] + j] = True
    repeat = np.bincount(w.doc[marked], minlength=len(texts))
    rows = []
    for i, t in enumerate(texts):
        t = t or ""
        lines = t.split("\n")
        full = [x for x in lines if x.strip(" \t\n\r\x0b\x0c")] if len(lines) > 1 else lines[:1]
        gaps = sum(t.count(c) for c in " \t\n\r\x0b\x0c")
        rows.append((int(n[i]), len(t) - gaps, sum(t.count(chr(c)) for c in SYMBOLS), len(full) - len(set(full)), int(repeat[i]), len(full) if n[i] else 0))
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"], dtype="int64")


def _stats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in slices(frames, "text"):
        out = text_stats(f["text"].tolist())
        out.insert(0, "id", f["id"].array)
        for c in f.columns[2:]:
            out[c] = f[c].array
        yield out


def with_stats(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: list[str]) -> DataFrame:
    """One row per document with its base statistics, group keys, base verdict and integer vector."""
    tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), null_safe_key(F.col(lang_col)).alias("lang"), null_safe_key(F.col(source_col)).alias("src"), *carry)
    got = rows.mapInPandas(_stats, STATS + ", lang string, src string" + "".join(f", {c} long" for c in carry))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]
    got = got.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return got.select("*", *(F.round(c * UNIT).cast("long").alias(name) for name, c in zip(FEATURES, x)))


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
MOMENTS = ["n", *(f"s{i}" for i in range(len(FEATURES))), *(f"s{i}_{j}" for i, j in PAIRS)]
ESTIMATE = "key string, mean array<double>, inverse array<double>"


def _moments() -> list:
    first = [F.sum(F.col(f)).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    second = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in PAIRS]
    return [F.count(F.lit(1)).alias("n"), *first, *second]


def solve(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse scatter from the integer moments of a subset; the floor keeps a constant statistic invertible."""
    p, n = len(FEATURES), int(row["n"])
    mean = np.array([int(row[f"s{i}"]) / n for i in range(p)])
    cov = np.empty((p, p))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = (n * int(row[f"s{i}_{j}"]) - int(row[f"s{i}"]) * int(row[f"s{j}"])) / (n * n) / UNIT**2
    # the concentrated subset holds the inner rows only; the factor makes its scatter consistent for normal data
    return mean / UNIT, np.linalg.inv(CONSISTENCY * cov + np.diag(FLOOR**2))


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        got = [solve(r) for r in f.to_dict("records")]
        yield pd.DataFrame({"key": f["key"].array, "mean": [m.tolist() for m, _ in got], "inverse": [v.ravel().tolist() for _, v in got]})


def distance() -> Column:
    """The squared Mahalanobis distance of a row to the estimate joined to it."""
    p, total = len(FEATURES), F.lit(0.0)
    d = [F.col(f) / F.lit(float(UNIT)) - F.element_at("mean", i + 1) for i, f in enumerate(FEATURES)]
    for i in range(p):
        for j in range(p):
            total = total + d[i] * d[j] * F.element_at("inverse", i * p + j + 1)
    return total


def pooled(rows: DataFrame, min_group: int) -> DataFrame:
    """Each row's estimation group: its (language, source), or the pool of its language's or of all small groups."""
    n = rows.groupBy("lang", "src").agg(F.count(F.lit(1)).alias("__n"))
    small = F.col("__n") < min_group
    by_lang = n.where(small).groupBy("lang").agg(F.sum("__n").alias("__l"))
    n = n.join(by_lang, "lang", "left")
    key = F.when(~small, F.to_json(F.struct("lang", "src"))).when(F.col("__l") >= min_group, F.to_json(F.struct("lang"))).otherwise(F.lit("all"))
    return sized_join(rows, written(n.select("lang", "src", key.alias("key")), "groups"), ["lang", "src"])


def medians(rows: DataFrame, step: int = 8) -> DataFrame:
    """The coordinate-wise medians of each group to within ``step`` units, from exact histograms."""
    long = rows.select("key", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(f) / step).alias("bin")) for i, f in enumerate(FEATURES)))).alias("f")).select("key", "f.i", "f.bin")
    hist = long.groupBy("key", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("key", "i")
    hist = hist.withColumn("up", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    mid = hist.where(F.col("up") * 2 >= F.col("all")).groupBy("key", "i").agg(F.min("bin").alias("bin"))
    return mid.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bin"))), lambda x: (x["bin"] * step + step / 2) / float(UNIT)).alias("mean"))


def estimates(rows: DataFrame, steps: int = 6, share: float = 0.75) -> DataFrame:
    """Minimum covariance determinant of each group: ``steps`` concentration steps from the medians.

    A step orders a group's rows by distance in fine logarithmic bins; moments are summed per (group, bin), which
    is bounded however large the group, and the subset is the first bins that hold ``share`` of the group.
    """
    flat = np.diag(1 / FLOOR**2).ravel().tolist()
    est = written(medians(rows).withColumn("inverse", F.array(*(F.lit(x) for x in flat))), "start")
    for step in range(steps):
        near = sized_join(rows, est, ["key"]).withColumn("bin", F.floor(F.log2(distance() + 1e-6) * 16))
        w = W.partitionBy("key")
        sums = near.groupBy("key", "bin").agg(*_moments())
        cum = sums.select("key", "bin", F.sum("n").over(w).alias("all"), *(F.sum(m).over(w.orderBy("bin")).alias(m) for m in MOMENTS))
        subset = cum.where(F.col("n") >= F.ceil(F.col("all") * share)).withColumn("r", F.row_number().over(w.orderBy("bin"))).where("r = 1")
        est = written(subset.select("key", *MOMENTS).mapInPandas(_solved, ESTIMATE), f"step{step}")
    return est


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, min_group: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the base statistics, base_failed, d2 (squared distance, null if base_failed), kept; and the
    columns ``carry`` (longs)."""
    rows = written(with_stats(docs, id_col, text_col, lang_col, source_col, list(carry)), "stats")
    good = written(pooled(rows.where(~F.col("base_failed")), min_group), "vectors")
    est = estimates(good)
    # verdicts depend on the vector and the group alone
    verdict = sized_join(good, est, ["key"]).withColumn("d2", distance())
    base = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *carry]
    passed = verdict.select(*base, "d2", (F.col("d2") <= cutoff).alias("kept"))
    failed = rows.where("base_failed").select(*base, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return passed.unionByName(failed)
