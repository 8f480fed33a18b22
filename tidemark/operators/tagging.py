"""Features in texts by named patterns, their sources, confidence, and counts in reviews: one scan for all features."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import confidence
from ..functions.text import text_or_blank
from . import phrases

#: Features and their patterns (fixed values: results depend on them).
DOMAIN = {
    "blocking": [
        r"\b(?:block|blocking|blocker|blacklist|whitelist)\b", r"\b(?:app|site|website)\s*block(?:er|ing)?\b", r"\b(?:site|website)\s*filter(?:ing|s)?\b", r"\bnuclear\s*option\b",
        r"\bdistraction\s*block(?:er|ing)?\b", r"\bporn\s*block(?:er|ing)?\b", r"\bsocial(?:\s*media)?\s*block(?:er|ing)?\b", r"\bshorts\s*block(?:er|ing)?\b", r"\breels?\s*block(?:er|ing)?\b",
    ],
    "timer": [r"\btimers?\b", r"\bcount\s*down\b", r"\bcount\s*up\b", r"\btime\s*tracking\b", r"\bwork\s*sessions?\b", r"\bbreak(?:\s*(?:timer|mode))?\b", r"\bvisual\s*timer\b"],
    "pomodoro": [r"\bpomodoro\b", r"\bpomo\b", r"\b25\s*min(?:ute)?\b", r"\b(?:4|four)\s*cycles?\b", r"\bshort\s*break\b", r"\blong\s*break\b"],
    "habit_tracking": [r"\bhabits?\b", r"\bstreaks?\b", r"\bdaily\s*goals?\b", r"\broutines?\b", r"\bcheck\s*ins?\b", r"\bbuild\s*habits?\b", r"\bchain(s)?\b"],
    "focus_mode": [r"\bfocus\s*mode\b", r"\bdeep\s*work\b", r"\bdistraction\s*free\b", r"\bconcentrat(?:e|ion)\b", r"\bflow\s*state\b", r"\bdo\s*not\s*disturb\b"],
    "screen_time": [r"\bscreen\s*time\b", r"\busage\s*stats?\b", r"\bdigital\s*wellbeing\b", r"\bapp\s*usage\b", r"\bdowntime\b", r"\busage\s*limit(s)?\b"],
    "parental_control": [
        r"\bparental\s*controls?\b", r"\bchild\s*lock\b", r"\bkid(?:s|z)\b", r"\bfamily\s*link\b", r"\bblock\s*(?:game|app)s?\s*for\s*(?:kids?|child)\b", r"\bremote\s*lock\b",
        r"\bapprove\s*downloads?\b", r"\bcontent\s*filter\b",
    ],
    "adhd_support": [
        r"\badhd\b", r"\badd\b", r"\bneuro\s*divergent\b", r"\bneurodivergent\b", r"\bneuro\s*diversit(?:y|ies)\b", r"\bautism\b", r"\basd\b", r"\b(?:adhd|asd)\s*(?:friendly|support|tool|tools)\b",
    ],
    "reminders": [r"\breminders?\b", r"\b(?:notify|notifications?)\b", r"\bnudges?\b", r"\bsnooze\b", r"\balarms?\b", r"\bpush\s*notifications?\b"],
    "analytics": [
        r"\banalytics?\b", r"\bstat(?:s|istics)\b", r"\breports?\b", r"\binsights?\b", r"\bcharts?\b", r"\bdashboards?\b", r"\btrends?\b", r"\bweekly\s*report\b", r"\btime\s*breakdown\b", r"\bprogress\b",
    ],
    "gamification": [r"\bgamif(?:ied|ication)\b", r"\bquests?\b", r"\bstreaks?\b", r"\bbadges?\b", r"\bpoints?\b", r"\blevels?\b"],
    "rewards": [r"\brewards?\b", r"\bearn\s*(?:coins|points)\b", r"\ballowance\b", r"\bunlock\b"],
    "calendar_integration": [r"\bcalendar\b", r"\bgoogle\s*calendar\b", r"\b(?:i|iCal|ical)\b", r"\boutlook\b", r"\bblock\s*calendar\s*time\b", r"\bcalendar\s*integration\b"],
    "todo_integration": [
        r"\bto[- ]?do\b", r"\btasks?\b", r"\blists?\b", r"\b(todoist|notion|google\s*tasks?|microsoft\s*to\s*do)\b", r"\bintegration(s)?\b.*\b(todo|task|notion|todoist)\b",
    ],
    "browser_extension": [r"\b(?:chrome|firefox|safari)\s*(?:extension|add-?on)\b", r"\bbrowser\s*(?:extension|add-?on)\b", r"\bextension\b", r"\badd-?on\b"],
    "web_filtering": [r"\bcontent\s*filter(?:ing)?\b", r"\bweb\s*filter(?:ing)?\b", r"\bporn(?:ography)?\s*filter\b", r"\bgambling\s*filter\b"],
    "whitelist_blacklist": [r"\ballowlist\b", r"\bdenylist\b", r"\bwhitelist\b", r"\bblacklist\b"],
    "scheduling": [r"\bschedules?\b", r"\bscheduled\b", r"\bbedtime\b", r"\bdowntime\b", r"\bcurfew\b", r"\broutines?\b", r"\bapp\s*limit(s)?\b"],
    "cross_device_sync": [r"\bsync(?:hroni[sz]e|hronization)?\b", r"\bcross-?device\b", r"\bcloud\s*sync\b", r"\bmulti-?platform\b"],
    "focus_music_noise": [r"\bfocus\s*music\b", r"\bbackground\s*sound(?:s)?\b", r"\b(?:white|brown|pink)\s*noise\b", r"\bambient\s*sound(?:s)?\b"],
}
#: Terms that flag a review (fixed values).
NEURODIVERSE = [
    r"\badhd\b", r"\bau?dhd\b", r"\badd\b", r"\bneurodivergen\w*\b", r"\bneurodivers\w*\b", r"\bnd[- ]?friendly\b", r"\bautis\w*\b", r"\basd\b", r"\basperger'?s?\b", r"\bdyslexi\w*\b",
    r"\bdyscalculi\w*\b", r"\bdysprax\w*\b", r"\btourette'?s?\b", r"\bsensory\s+processing\b", r"\bexecutive\s+function\w*\b",
]


def alternation(patterns: list[str]) -> str:
    """One pattern for all, whatever the case; words and white space in Unicode's terms."""
    return "(?iU)" + "|".join(patterns)


def words(*terms: str) -> dict[str, list[str]]:
    """A pattern table with a feature for each plain word."""
    return {t: [rf"\b{re.escape(t)}\b"] for t in terms}


def tags_each(texts: Sequence[Column], features: Mapping[str, list[str]] = DOMAIN) -> Column:
    """For each of some texts the features that it shows, in table order, as an array of arrays. One pass finds all whose patterns
    begin with literals; the others are searched one by one."""
    quick = {n: p for n, p in features.items() if phrases.begun(tuple(p))}
    found = phrases.shown_each(texts, quick)
    if len(quick) == len(features):
        return found
    hit = lambda i, text: (F.when(F.array_contains(found[i], name) if name in quick else text.rlike(alternation(p)), F.lit(name)) for name, p in features.items())
    return F.array(*(F.array_compact(F.array(*hit(i, text))) for i, text in enumerate(texts)))


def tags(text: Column, features: Mapping[str, list[str]] = DOMAIN) -> Column:
    """The features that a text shows, in table order."""
    return tags_each([text], features)[0]


def neurodiverse(title: Column, body: Column) -> Column:
    return F.size(tags(F.concat_ws("\n", title, body), {"special": NEURODIVERSE})) > 0


def tag_counts(df: DataFrame, keys: list[str], text: Column, features: Mapping[str, list[str]] = DOMAIN, measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Per key and feature: hits, and the means of the measures over matching rows. One scan, one shuffle."""
    means = {n: c.alias(n) for n, c in (measures or {}).items()}
    rows = df.select(*keys, *means.values(), F.explode(tags(text, features)).alias("feature"))
    return rows.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("hits"), *(F.avg(n).alias(f"avg_{n}") for n in means))


def matching_counts(df: DataFrame, keys: list[str], text: Column, features: Mapping[str, list[str]] = DOMAIN) -> DataFrame:
    """Per key a column for each feature with the number of matching rows, zeros included."""
    rows = df.select(*keys, tags(text_or_blank(text), features).alias("__shown"))
    return rows.groupBy(*keys).agg(*(F.count_if(F.array_contains("__shown", name)).alias(name) for name in features))


def longened(wide: DataFrame, keys: list[str], features: list[str], value: str) -> DataFrame:
    return wide.unpivot(keys, features, "feature", value)


def sources(fields: Mapping[str, Column], feature: str) -> Column:
    """The names of the fields that show the feature, in order. ``fields``: the features that each one shows."""
    return F.array_compact(F.array(*(F.when(F.array_contains(c, feature), F.lit(name)) for name, c in fields.items())))


def feature_signals(apps: DataFrame, keys: list[str], fields: Mapping[str, Column], hits: DataFrame, features: Mapping[str, list[str]] = DOMAIN, least: float = 0.55) -> DataFrame:
    """Per app and feature with enough evidence: confidence, signals (sources, or "reviews"), review_hits.
    ``hits``: (keys, feature, review_hits), aggregated once for all features.

    Texts are searched where they are read. One map of hits for each app is joined, and an app's features become rows
    only where there is evidence.
    """
    shown = {name: F.col("__shown")[i] for i, name in enumerate(fields)}
    apps = apps.select(*keys, tags_each([text_or_blank(c) for c in fields.values()], features).alias("__shown"))
    found = F.array(*(F.struct(F.lit(n).alias("feature"), sources(shown, n).alias("found")) for n in features))
    counts = hits.where(F.col("feature").isin(*features)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "review_hits"))).alias("__hits"))  # a feature has one row
    rows = apps.select(*keys, found.alias("__found")).join(counts, keys, "left")

    def one(x: Column) -> Column:
        n = F.coalesce(F.try_element_at("__hits", x["feature"]), F.lit(0)).cast("bigint")
        named = F.when(F.size(x["found"]) > 0, F.array_join(x["found"], ",")).when(n > 0, F.lit("reviews")).otherwise(F.lit(""))
        return F.struct(x["feature"].alias("feature"), confidence(F.size(x["found"]), n).alias("confidence"), named.alias("signals"), n.alias("review_hits"), F.size(x["found"]).alias("n"))

    evident = F.filter(F.transform("__found", one), lambda r: (r["n"] > 0) | (r["confidence"] >= least))
    return rows.select(*keys, F.inline(evident)).drop("n")
