"""Filters, quality gates and reasons for rejection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number_or
from ..functions.text import text_or_blank, word_count


def popular(store: Column, ratings: Column, installs: Column, least_ratings: float, least_installs: float, least_users: float) -> Column:
    """Enough ratings, or enough installs or users for the store."""
    r, i, s = number_or(ratings, 0), number_or(installs, 0), text_or_blank(store)
    return (r >= least_ratings) | ((s == "PlayStore") & (i >= least_installs)) | ((s == "ChromeWS") & (i >= least_users))


def relevant(score: Column, least: float) -> Column:
    return number_or(score, 0) >= least


def readable(title: Column, description: Column) -> Column:
    """A title or a description, and no title of fewer than two signs (no title at all is long enough)."""
    return (title.isNotNull() | description.isNotNull()) & (title.isNull() | (F.length(title) >= 2))


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the failed checks, joined by commas; null if all pass."""
    failed = F.concat_ws(",", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    return F.nullif(failed, F.lit(""))


def split(df: DataFrame, reason: str = "drop_reason") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a frame with reasons."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def mentions(text: Column, terms: list[str]) -> Column:
    low = F.lower(text_or_blank(text))
    return reduce(lambda a, t: a | F.contains(low, F.lit(t.lower())), terms, F.lit(False))


def included(text: Column, include: list[str], exclude: list[str]) -> Column:
    """Some included term (any text if there are none) and no excluded one."""
    return (mentions(text, include) if include else F.lit(True)) & ~mentions(text, exclude)


def filtered_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition, or all of them if none does."""
    got = df.where(condition)
    return df if got.isEmpty() else got


def long_enough(text: Column, least_words: int = 0, least_chars: int = 0) -> Column:
    return (word_count(text) >= least_words) & (F.length(text_or_blank(text)) >= least_chars)


def searched(df: DataFrame, column: str, query: str | None) -> DataFrame:
    """Rows whose text matches the pattern, whatever its case; all rows without a query."""
    return df.where(F.coalesce(F.col(column).rlike("(?i)" + query), F.lit(False))) if query else df


def faceted(df: DataFrame, facets: dict[str, str], bypass: str = "All") -> DataFrame:
    return reduce(lambda d, f: d if f[1] == bypass else d.where(F.col(f[0]) == f[1]), facets.items(), df)
