"""Sentiment of texts: a lexicon engine, a keyword engine, and any engine given as a Column or a Pandas function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import polarity
from ..functions.text import text_or_blank

#: Our own small lexicon, in three steps of our own.
LEXICON = (
    dict.fromkeys(("love", "loved", "best", "amazing", "awesome", "excellent", "perfect", "great"), 3.0)
    | dict.fromkeys(("good", "nice", "happy", "fun", "helpful", "useful", "better", "easy", "smooth", "recommend"), 2.0)
    | dict.fromkeys(("like", "help", "thanks", "works", "worth"), 1.0)
    | dict.fromkeys(("slow", "issue", "issues", "ads", "expensive", "bug", "bugs"), -1.0)
    | dict.fromkeys(("bad", "worse", "buggy", "broken", "problem", "problems", "annoying", "crash", "crashes", "useless", "waste", "fail"), -2.0)
    | dict.fromkeys(("worst", "hate", "awful", "terrible", "scam"), -3.0)
)
#: Words that turn the next words round, and words that make them stronger or weaker.
NEGATIONS = ("not", "no", "never", "none", "nothing", "hardly", "without", "cannot", "can't", "cant", "don't", "dont", "doesn't", "doesnt", "didn't", "didnt", "isn't", "isnt", "wasn't", "wasnt", "won't", "wont")
STRONGER = ("very", "really", "extremely", "so", "totally", "absolutely", "completely", "incredibly")
WEAKER = ("slightly", "somewhat", "barely", "kinda", "almost", "partly")
#: How much a negation keeps of a weight and with which sign, what a booster adds, and what an exclamation mark adds (four at most).
TURN, BOOST, MARK = -0.74, 0.293, 0.292
#: Words of the keyword engine (fixed values); positive ones are looked for first.
POSITIVE = ("good", "great", "love", "help", "focus", "improve", "useful", "amazing")
NEGATIVE = ("bad", "bug", "crash", "issue", "problem", "hate", "annoying")


def keyword_label(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    low = F.lower(text_or_blank(text))
    return F.when(low.rlike("|".join(positive)), "Positive").when(low.rlike("|".join(negative)), "Negative").otherwise("Neutral")


def lexicon_score(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """s / sqrt(s^2 + 15) of the sum s of the words' weights, to four decimals. All in one expression per row: the words
    are looked up in a literal map."""
    found = F.split(F.lower(text_or_blank(text)), r"[^\p{L}\p{N}']+")
    table = F.create_map(*(F.lit(x) for pair in sorted(lexicon.items()) for x in pair))
    total = F.aggregate(found, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    return F.round(total / F.sqrt(total * total + 15), 4)


def valence_score(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """Like ``lexicon_score``, but a word's weight is turned round by a negation among the three words before it, changed by
    boosters there (less so from further away), and the sum is raised by exclamation marks."""
    raw = text_or_blank(text)
    found = F.filter(F.split(F.lower(raw), r"[^\p{L}\p{N}']+"), lambda w: w != "")
    table = F.create_map(*(F.lit(x) for pair in sorted(lexicon.items()) for x in pair))

    def one(w: Column, i: Column) -> Column:
        weight = F.try_element_at(table, w)
        sign = F.signum(weight)
        before = [F.get(found, i - d) for d in (1, 2, 3)]
        boost = sum((F.when(b.isin(*STRONGER), BOOST * f).when(b.isin(*WEAKER), -BOOST * f).otherwise(0.0) for b, f in zip(before, (1.0, 0.95, 0.9))), F.lit(0.0))
        turned = F.coalesce(before[0].isin(*NEGATIONS), F.lit(False)) | F.coalesce(before[1].isin(*NEGATIONS), F.lit(False)) | F.coalesce(before[2].isin(*NEGATIONS), F.lit(False))
        return F.coalesce((weight + sign * boost) * F.when(turned, F.lit(TURN)).otherwise(1.0), F.lit(0.0))

    total = F.aggregate(F.transform(found, one), F.lit(0.0), lambda s, v: s + v)
    total = total + F.signum(total) * MARK * F.least(F.regexp_count(raw, F.lit("!")), F.lit(4))
    return F.round(total / F.sqrt(total * total + 15), 4)


ENGINES: dict[str, Callable[[Column], Column]] = {
    "lexicon": valence_score,
    "words": lexicon_score,
    "keywords": lambda text: F.when(keyword_label(text) == "Positive", 0.5).when(keyword_label(text) == "Negative", -0.5).otherwise(0.0),
}
#: Names of models that aren't here; they fall back on the lexicon.
ABSENT = ("vader", "hf", "transformer", "roberta")


def engine(name: str | None, fallback: str = "lexicon") -> Callable[[Column], Column]:
    """The engine of this name; the fallback for no name and for models that aren't here; an error for an unknown name. An
    engine maps a text column to a score column; a Pandas function that is registered here works too."""
    if not name or name.lower() in ABSENT:
        return ENGINES[fallback]
    if name.lower() not in ENGINES:
        raise ValueError(f"unknown engine: {name}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[name.lower()]


def with_sentiment(df: DataFrame, text: str, name: str = "lexicon") -> DataFrame:
    return df.withColumn("sentiment_score", engine(name)(F.col(text))).withColumn("sentiment_label", polarity(F.col("sentiment_score")))
