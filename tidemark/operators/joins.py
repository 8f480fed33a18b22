"""Joins of the tables with one another. Right sides have one row per key before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .dedupe import keep_first
from .schema import suffixed


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], seq: list[Column], suffix: str = "_right") -> DataFrame:
    """Left join with a right side that is deduped first (its first row by ``seq``); clashing names get a suffix."""
    return left.join(suffixed(keep_first(right, keys, seq), left.columns, suffix, keys), keys, "left")


def enriched(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left join with a side that is one row per key already; clashing names get a suffix."""
    return left.join(suffixed(right, left.columns, suffix, keys), keys, "left")


def on_shared(left: DataFrame, right: DataFrame, keys: list[str], must: str, suffix: str = "_right") -> DataFrame:
    """Left join on those of the keys that both sides have; ``must`` has to be one."""
    use = [k for k in keys if k in left.columns and k in right.columns]
    if must not in use:
        raise ValueError(f"{must} is not a column of both sides")
    return enriched(left, right, use, suffix)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key isn't done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows and the new rows with new keys."""
    return old.unionByName(not_done(new, old, keys), allowMissingColumns=True)
