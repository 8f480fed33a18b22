"""Relevance of a record from weighted terms, its category, popularity and age."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import recency_bonus
from ..functions.numbers import clamp, log_bonus, number_or
from ..functions.text import text_or_blank
from . import phrases


@dataclass(frozen=True)
class Weights:
    """Term lists and weights. The numbers and lists are fixed values: results depend on them."""

    include_terms: tuple[str, ...] = (
        "focus", "focused", "productivity", "productive", "pomodoro", "timer", "countdown", "study", "study timer", "deep work", "habit",
        "routine", "adhd", "mindful", "meditation", "block", "blocker", "website blocker", "site blocker", "distraction", "parental", "screen time",
    )
    include_phrases: tuple[str, ...] = ("site blocker", "website blocker", "parental control", "screen time", "focus timer", "study timer", "deep work")
    exclude_terms: tuple[str, ...] = ("wallpaper", "theme", "ringtone", "launcher", "keyboard", "icon", "vpn", "antivirus", "camera", "photo", "video", "music", "game", "gallery", "widget")
    exclude_phrases: tuple[str, ...] = ()
    #: field: (weight, multiplier of included terms, multiplier of excluded terms)
    fields: dict = field(default_factory=lambda: {"title": (3.0, 1.0, 2.0), "category": (2.0, 0.8, 1.5), "description": (1.0, 0.6, 0.5), "developer": (0.5, 0.4, 0.5)})
    categories: dict = field(
        default_factory=lambda: {
            "PlayStore": ("PRODUCTIVITY", "EDUCATION", "HEALTH_AND_FITNESS"),
            "ChromeWS": ("Productivity", "Education", "Utilities"),
            "AppStore": ("Productivity", "Education", "Health & Fitness"),
        }
    )
    poor_categories: tuple[str, ...] = ("wallpaper", "ringtones", "themes", "games")
    scale: float = 7.0
    category_bonus: float = 0.12
    category_penalty: float = 0.08
    popularity_cap: float = 0.18
    #: days up to which an update is fresh and from which it is stale, bonus and penalty
    recency: tuple[int, int, float, float] = (365, 1095, 0.10, 0.10)

    def plus(self, include: list[str] = (), exclude: list[str] = ()) -> Weights:
        """With more terms, in lower case, without repeats."""
        add = lambda old, new: tuple(dict.fromkeys([*old, *(t.strip().lower() for t in new if t.strip())]))
        return replace(self, include_terms=add(self.include_terms, include), exclude_terms=add(self.exclude_terms, exclude))


def field_scores(columns: dict[str, Column], w: Weights) -> list[Column]:
    """The score of each weighted field that there is. Terms count as often as they stand in the text as whole words, phrases once
    each; all terms of all fields in one pass. Terms of several words count besides the words in them."""
    fields = [f for f in w.fields if f in columns]
    if not fields:
        return []
    lows = [F.lower(text_or_blank(columns[f])) for f in fields]
    every = phrases.term_sums_each(lows, [(w.include_terms, False), (w.include_phrases, True), (w.exclude_terms, False), (w.exclude_phrases, True)])
    out = []
    for i, f in enumerate(fields):
        weight, times, minus = w.fields[f]
        n = every[i]
        good = F.lit(times) * n[0] + 2 * n[1]
        bad = F.lit(minus) * n[2] + F.lit(2 * minus) * n[3]
        out.append(F.lit(weight) * (good - bad))
    return out


def relevance(columns: dict[str, Column], store: Column, ratings: Column, installs: Column, updated: Column, as_of: dt.date, w: Weights | None = None) -> Column:
    """Relevance from 0 to 1, to three decimals. ``columns``: the text of each weighted field."""
    w = w or Weights()
    total = reduce(lambda a, b: a + b, field_scores(columns, w), F.lit(0.0))
    category = columns.get("category", F.lit(None).cast("string"))
    allowed = reduce(lambda a, s: a | ((store == s) & category.isin(*w.categories[s])), w.categories, F.lit(False))
    poor = reduce(lambda a, p: a | F.contains(F.lower(text_or_blank(category)), F.lit(p)), w.poor_categories, F.lit(False))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / w.scale))
    score = score + F.when(F.coalesce(allowed, F.lit(False)), w.category_bonus).otherwise(0.0) - F.when(poor, w.category_penalty).otherwise(0.0)
    score = score + log_bonus(number_or(ratings, 0), w.popularity_cap) + log_bonus(number_or(installs, 0), w.popularity_cap)
    return clamp(score + recency_bonus(updated, as_of, *w.recency))


def simple_relevance(fields: list[Column], ratings: Column, installs: Column, include: list[str], exclude: list[str]) -> Column:
    """The older score: substring hits over the number of terms, with small steps for popularity. The steps are fixed values:
    results depend on them."""
    text = F.lower(F.concat_ws(" ", *fields))
    hits = lambda terms: reduce(lambda a, t: a + (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t), terms, F.lit(0.0))
    base = F.greatest(F.lit(0.0), hits(include) - 2 * hits(exclude)) / max(5.0, float(len(include)))
    r, i = number_or(ratings, 0), number_or(installs, 0)
    step = F.when(r >= 10_000, 0.10).when(r >= 1000, 0.05).when((r > 0) & (r < 25), -0.10).otherwise(0.0)
    return clamp(base + step + F.when(i >= 10_000_000, 0.10).when(i >= 1_000_000, 0.05).otherwise(0.0))
