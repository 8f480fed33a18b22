"""Sorts that are chosen when a plan is built, and caps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import first_digits, number


def ordering(*by: tuple[str, str]) -> list[Column]:
    """Columns to sort by, each in its own direction: ("confidence", "desc"), ("title", "asc"); nulls last in both."""
    out = []
    for name, direction in by:
        if direction not in ("asc", "desc"):
            raise ValueError(f"not a direction: {direction}")
        out.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last())
    return out


#: The order of feature rows: the surest first, then the most reviewed, then by title.
SUREST = (("confidence", "desc"), ("review_hits", "desc"), ("title", "asc"))
#: What a list of apps can be sorted by.
CHOICES = {"rating": lambda: number(F.col("rating_avg")), "installs": lambda: first_digits(F.col("installs_or_users"))}


def chosen_order(choice: str, ties: list[str], choices: Mapping = CHOICES) -> list[Column]:
    """The order for a choice such as "Rating (high to low)" or "installs asc": the first known name in it, falling unless it
    asks for low or ascending first; rows without a value last; an unknown choice sorts by the ties only."""
    low = choice.lower()
    name = next((n for n in choices if n in low), None)
    rising = "asc" in low or low.find("low") != -1 and (low.find("high") == -1 or low.find("low") < low.find("high"))
    first = [] if name is None else [choices[name]().asc_nulls_last() if rising else choices[name]().desc_nulls_last()]
    return [*first, *(F.col(t).asc() for t in ties)]


def capped(df: DataFrame, most: int | None, by: list[Column]) -> DataFrame:
    """At most so many rows in all, the first by ``by``; all without a cap."""
    return df.orderBy(*by).limit(most) if most else df
