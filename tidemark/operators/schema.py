"""Columns of records from many sources: aliases, defaults, names, keys. Choices are made when a plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def existing(df: DataFrame, names: Iterable[str], default: object = None) -> Column:
    """The first of the names that is a column, whatever it holds; else the default."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(default))


def filled(df: DataFrame, names: Iterable[str], default: object = None) -> Column:
    """The first of the columns that has any value at all (one pass over those columns); else the default."""
    there = [n for n in names if n in df.columns]
    if not there:
        return F.lit(default)
    seen = df.agg(*(F.max(F.col(f"`{n}`").isNotNull()).alias(str(i)) for i, n in enumerate(there))).first()
    return next((F.col(f"`{n}`") for i, n in enumerate(there) if seen[i]), F.lit(default))


def resolved(df: DataFrame, aliases: Mapping[str, Iterable[str]], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """One column for each target name, from the first alias that exists."""
    return df.select(*(existing(df, names, (defaults or {}).get(target)).alias(target) for target, names in aliases.items()))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Columns that are missing are added with their defaults."""
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in defaults.items() if c not in df.columns})


def wanted(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The wanted columns that there are, in the wanted order."""
    return df.select(*(F.col(f"`{n}`") for n in names if n in df.columns))


def required(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def normal_names(df: DataFrame) -> DataFrame:
    """Names in lower case, other signs than letters and digits as underscores; names that clash are numbered."""
    out: list[str] = []
    for c in df.columns:
        name = re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") or "column"
        n = sum(o == name or re.fullmatch(rf"{re.escape(name)}_\d+", o) is not None for o in out)
        out.append(f"{name}_{n}" if n else name)
    return df.toDF(*out)


def normal_cells(df: DataFrame) -> DataFrame:
    """Text cells stripped; blanks and "nan" are null."""
    return df.select(*(blank_to_null(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def by_prefix(df: DataFrame, prefix: str) -> str | None:
    return next((c for c in df.columns if c.lower().startswith(prefix.lower())), None)


def by_part(df: DataFrame, *parts: str) -> str | None:
    return next((c for p in parts for c in df.columns if p.lower() in c.lower()), None)


def suffixed(df: DataFrame, taken: Iterable[str], suffix: str, keys: Iterable[str]) -> DataFrame:
    """Columns that clash with ``taken`` get a suffix, before a join on ``keys``."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in set(taken) and c not in set(keys)})
