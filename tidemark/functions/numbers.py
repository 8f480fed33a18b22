"""Numbers in text, scores and labels as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_blank


def number(c: Column) -> Column:
    """A double, or null where the text isn't one."""
    return c.cast("string").try_cast("double")


def number_or(c: Column, default: float) -> Column:
    return F.coalesce(number(c), F.lit(default))


def scaled(c: Column) -> Column:
    """The first number of a text with its k or m: "10M+", "742K", "10,000,000+ downloads"."""
    t = F.regexp_replace(text_or_blank(c), r"[,+]", "")
    n = F.regexp_extract(t, r"(\d+(?:\.\d+)?)([kKmM])?", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(t, r"(\d+(?:\.\d+)?)([kKmM])?", 2))
    return F.round(n * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)).cast("bigint")


def compact(c: Column) -> Column:
    """A number with k or m if the whole text is one, else the first run of digits and commas."""
    t = F.regexp_replace(F.trim(text_or_blank(c)), ",", "")
    whole = F.when(t.rlike(r"^\d+(\.\d+)?[kKmM]$"), scaled(t))
    return F.coalesce(whole, F.regexp_replace(F.regexp_extract(text_or_blank(c), r"(\d[\d,]*)", 1), ",", "").try_cast("bigint"))


def users(c: Column) -> Column:
    """The number before the word users."""
    return compact(F.nullif(F.regexp_extract(text_or_blank(c), r"(?i)([\d,.km]+)\s+users\b", 1), F.lit("")))


def first_digits(c: Column) -> Column:
    """The first run of digits once commas are gone."""
    return F.regexp_extract(F.regexp_replace(text_or_blank(c), ",", ""), r"(\d+)", 1).try_cast("bigint")


def prices(c: Column) -> Column:
    """All amounts after a currency sign or code, in order."""
    got = F.regexp_extract_all(text_or_blank(c), F.lit(r"(?:[$€£]|USD|EUR|GBP)\s*(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.filter(F.transform(got, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull())


def price_range(c: Column) -> tuple[Column, Column, Column]:
    """(least, greatest, number) of the amounts in a text; nulls and 0 without any."""
    p = prices(c)
    return F.array_min(p), F.array_max(p), F.size(p).cast("bigint")


def price_label(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), F.lit("Free")).otherwise(F.format_string("$%.2f", c.cast("double")))


def clamp(c: Column, digits: int = 3) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), digits)


def log_bonus(c: Column, cap: float) -> Column:
    """``cap`` at ten millions and above, falling with the logarithm; 0 for nothing."""
    return F.when(c > 0, F.lit(cap) * F.least(F.lit(1.0), F.log10(c.cast("double")) / 7)).otherwise(F.lit(0.0))


def confidence(sources: Column, hits: Column) -> Column:
    """The ladder from the number of text sources with a signal and the number of matching reviews (fixed values)."""
    return F.when(sources >= 2, 0.80).when((sources == 1) & (hits >= 10), 0.70).when(sources == 1, 0.60).when(hits >= 25, 0.55).otherwise(0.0)


def threshold_flag(conf: Column, hits: Column, least_conf: float = 0.60, least_hits: int = 5) -> Column:
    return F.coalesce((conf >= least_conf) & (hits >= least_hits), F.lit(False)).cast("int")


def polarity(score: Column) -> Column:
    """The label of a score, by limits that are fixed values."""
    return F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").when(score.isNotNull(), "neutral")


def score_bin(score: Column) -> Column:
    """Negative (-1, -0.05], Neutral (-0.05, 0.05], Positive (0.05, 1] (fixed values); null outside."""
    return F.when((score > -1) & (score <= -0.05), "Negative").when((score > -0.05) & (score <= 0.05), "Neutral").when((score > 0.05) & (score <= 1), "Positive")


#: Support labels and their values (fixed values).
SUPPORT = {"supportive": 1, "neutral": 0, "undermining": -1}


def support_value(label: Column) -> Column:
    """1, 0 or -1; 0 for unknown labels."""
    return reduce(lambda rest, k: F.when(label == k, F.lit(SUPPORT[k])).otherwise(rest), SUPPORT, F.lit(0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """The weighted mean, a null value or weight counting as 0; the plain mean where the weights sum to nothing."""
    v, w = number_or(value, 0.0), number_or(weight, 0.0)
    return F.when(F.sum(w) <= 0, F.avg(v)).otherwise(F.try_divide(F.sum(v * w), F.sum(w)))
