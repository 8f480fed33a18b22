"""Phrases in one pass against a search for each pattern."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import phrases, tagging

PIECES = [
    "whitelist", "blacklist", "rewards", "unlock", "reminder", "snooze", "web filter", "web", "gambling", "filtering", "calendar", "outlook", "level", "schedule", "music", "report", "routine",
    "block", "blocking", "app", "site", "website", "blocker", "filter", "nuclear", "option", "porn", "social", "media", "shorts", "reel", "reels", "timer", "timers", "count", "down", "countdown", "up", "25", "min", "minute", "4", "four", "cycles",
    "short", "break", "mode", "habit", "check", "ins", "chain", "chains", "focus", "deep", "work", "flow", "state", "do", "not", "disturb", "screen", "time", "usage", "stats", "limit", "kid", "kidz", "family", "link", "adhd", "ADD", "add", "neuro",
    "divergent", "diversities", "asd", "friendly", "i", "iCal", "I", "to", "todo", "to-do", "notion", "google", "tasks", "microsoft", "integration", "integrations", "add-on", "addon", "chrome", "extension", "synchronise", "sync", "cross-device",
    "white", "noise", "gamified", "neurodivergence", "neurodiverse", "nd-friendly", "nd", "autistic", "asperger's", "aspergers", "dyslexia", "tourette's", "sensory", "processing", "executive", "functioning", "K", "ſync", "İcal", "bloc", "k", "é", "é", "x_", "_",
]
GAPS = [" ", " ", " ", "", "-", "\n", "\t", "  ", ", ", ".", " ", "́", "‍", "\x1c", " ", "1", "é", "_"]


def made(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) + rnd.choice(GAPS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_features_equal_a_search_for_each(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*made(4000, 1), "pomodoro", "white noise", "web filter", "snooze", "unlock", None, ""])], "i int, t string").repartition(4)
    both = {**tagging.DOMAIN, "special": tagging.NEURODIVERSE}
    plain = F.array_compact(F.array(*(F.when(F.col("t").rlike(tagging.alternation(p)), F.lit(n)) for n, p in both.items())))
    got = rows.select("t", phrases.shown(F.col("t"), both).alias("got"), F.coalesce(plain, F.array()).alias("want")).collect()
    wrong = [(r.t, r.got, r.want) for r in got if r.got != r.want]
    assert not wrong, wrong[:3]
    assert {n for r in got for n in r.got} == set(both)


def test_documents_equal_a_search_for_each(spark, sf):
    words = tagging.words("the", "of", "that", "with", "und", "der", "la") | {"pairs": [r"\bof\s+the\b", r"\bthe\s*of\b"]}
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    plain = F.array_compact(F.array(*(F.when(F.col("text").rlike(tagging.alternation(p)), F.lit(n)) for n, p in words.items())))
    assert rows.where(~phrases.shown(F.col("text"), words).eqNullSafe(plain)).count() == 0


def test_terms_equal_counts_of_patterns(spark):
    terms = ["block", "app", "to", "i", "count down", "time", "break", "a b a", "c++", "4"]
    texts = [*made(2000, 2), "a b a b a", "c++ c+++ xc++", None]
    low = F.lower(F.coalesce("t", F.lit("")))
    count = [F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])\Q{t}\E(?![\p{{L}}\p{{N}}_])")) for t in terms]
    want = F.array(sum(count, F.lit(0)), sum(((c > 0).cast("int") for c in count), F.lit(0)))
    got = phrases.term_sums(low, [(terms, False), (terms, True)])
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~got.eqNullSafe(want)).count() == 0 and rows.where(got[0] > 0).count() > 100


def test_patterns_that_may_begin_with_anything_are_searched(spark):
    assert not phrases.begun((r"\b\w+x\b",)) and not phrases.begun((r"x",)) and not phrases.begun((r"\ba?b?",)) and phrases.begun((r"\b(?:a|b)c?d*",))
    assert phrases.beginnings(r"\b(?:ab|[cd]e)?f\w*") == {"abf", "cef", "def", "f"}
    assert phrases.beginnings(r"\ba+b") == {"a"} and phrases.beginnings(r"\bx(?:\w|yy)z") == {"x", "xyyz"}
    with pytest.raises(ValueError):
        phrases.beginnings(r"\b.x")
    rows = spark.createDataFrame([("an ox and ab",)], "t string")
    assert rows.select(tagging.tags(F.col("t"), {"any": [r"\b\w+x\b"], "ab": [r"\bab\b"], "no": [r"\bb\b"]})).first()[0] == ["any", "ab"]
