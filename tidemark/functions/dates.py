"""Dates and times as Column expressions. What today is is always a parameter."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, text_or_blank

#: The accepted formats, in the order in which they are tried (fixed values).
FORMATS = ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd")


def _may_fit(t: Column, form: str) -> Column:
    """Whether a text has what every text of this format has: a digit and all signs that stand in the format; nothing but digits (and
    a sign) where the format has numbers alone. Reading a text that doesn't fit costs many times as much. Formats with other letters
    or optional parts are always tried."""
    bare = re.sub(r"'[^']*'", "", form)
    signs = [t.contains(s) for s in dict.fromkeys(re.sub(r"[A-Za-z]", "", bare))]
    if re.search(r"[^yMdHmsX\W]|[\[\]']", bare) or (not signs and re.search("MMM|X", bare)):
        return F.lit(True)
    return reduce(lambda a, b: a & b, signs, t.rlike("[0-9]")) if signs else t.rlike(r"^[+-]?[0-9]+$")


def parsed_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A date, or null where no format fits the whole text."""
    t = squeeze(text_or_blank(c))
    return F.coalesce(*(F.when(_may_fit(t, f), F.try_to_timestamp(t, F.lit(f)).cast("date")) for f in formats))


def iso_or_raw(c: Column, formats: tuple[str, ...] = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd")) -> Column:
    """The ISO date, or the squeezed text itself where it isn't a date; null for a blank."""
    return F.coalesce(F.date_format(parsed_date(c, formats), "yyyy-MM-dd"), F.nullif(squeeze(text_or_blank(c)), F.lit("")))


def iso_only(c: Column) -> Column:
    return parsed_date(c, ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX"))


def instant(c: Column) -> Column:
    """A UTC instant from ISO text, or null."""
    return F.try_to_timestamp(F.nullif(F.trim(text_or_blank(c)), F.lit("")))


def iso_z(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def recency_bonus(day: Column, as_of: dt.date, fresh: int = 365, stale: int = 1095, bonus: float = 0.10, penalty: float = 0.10) -> Column:
    age = F.datediff(F.lit(as_of), day)
    return F.when(age <= fresh, F.lit(bonus)).when(age >= stale, F.lit(-penalty)).otherwise(F.lit(0.0))


def since(ts: Column, as_of: dt.datetime, days: int) -> Column:
    """Not older than ``days``; rows without a time don't pass."""
    return F.coalesce(ts >= F.lit(as_of - dt.timedelta(days=days)), F.lit(False))


def since_or_unread(raw: Column, as_of: dt.datetime, days: int) -> Column:
    """Not older than ``days``, or with a text that can't be read as a time; missing ones don't pass."""
    ts = instant(raw)
    return raw.isNotNull() & (ts.isNull() | (ts >= F.lit(as_of - dt.timedelta(days=days))))
