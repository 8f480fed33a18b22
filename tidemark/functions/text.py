"""Text as Column expressions: cleaning, slugs, keys, templates."""

from __future__ import annotations

import ast
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

URL = r"(?i)https?://\S+|www\.\S+"


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Stripped, with each run of white space as one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column, also: tuple[str, ...] = ("nan",)) -> Column:
    """Stripped; null if nothing is left or the text is one of ``also``."""
    s = strip(c.cast("string"))
    return F.when((s != "") & ~F.lower(s).isin(*also), s)


def cut(c: Column, n: int) -> Column:
    return F.substring(text_or_blank(c), 1, n)


def feature_name(c: Column) -> Column:
    """The form in which feature names are compared."""
    return F.lower(squeeze(text_or_blank(c)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_or_blank(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def app_slug(title: Column, store: Column) -> Column:
    """A readable id: the title's slug and the store."""
    return F.concat(slug(title), F.lit("_"), F.lower(text_or_blank(store)))


def first_filled(*columns: Column) -> Column:
    """The first of the columns that isn't null or blank in this row."""
    return F.coalesce(*(F.when(strip(text_or_blank(c)) != "", c.cast("string")) for c in columns))


def compose(title: Column, body: Column) -> Column:
    """"title. body" with both, else the one there is, else an empty text."""
    parts = [F.when(strip(text_or_blank(c)) != "", strip(text_or_blank(c))) for c in (title, body)]
    return F.concat_ws(". ", *parts)


def without_urls(c: Column) -> Column:
    """URLs become spaces, then white space is squeezed."""
    return squeeze(F.regexp_replace(text_or_blank(c), URL, " "))


def review_form(c: Column) -> Column:
    """What two copies of a review share: lower case, no URLs, no punctuation, single spaces."""
    bare = F.regexp_replace(F.lower(text_or_blank(c)), URL, " ")
    return squeeze(F.regexp_replace(bare, r"(?U)[^\w\s]+", " "))


def review_hash(key: Column, body: Column) -> Column:
    return F.md5(F.concat_ws("|", text_or_blank(key), review_form(body)))


def word_count(c: Column) -> Column:
    return F.regexp_count(text_or_blank(c), F.lit(r"\S+")).cast("bigint")


#: Store prefixes of keys, and the names under which stores appear (fixed values).
STORE_PREFIX = {"play": "PlayStore", "ios": "AppStore", "cws": "ChromeWS"}
STORE_NAMES = {
    "PlayStore": ("playstore", "googleplay", "google_play", "android"),
    "AppStore": ("appstore", "ios", "apple_app_store", "apple"),
    "ChromeWS": ("chromews", "chrome_web_store", "chromewebstore", "cws"),
}


def _looked_up(pairs: dict[str, str], c: Column) -> Column:
    """What a value stands for; null if nothing. The value is computed once, however many there are to compare it with."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), c)


def store_name(c: Column) -> Column:
    """One name for each store; other names stay as they are."""
    return F.coalesce(_looked_up({n: s for s, names in STORE_NAMES.items() for n in names}, F.lower(strip(c))), c)


def app_key(store: Column, app_id: Column) -> Column:
    """prefix:id, the one spelling of keys; iOS ids are reduced to their digits. Null without an id."""
    text = strip(app_id.cast("string"))
    prefix = _looked_up({n: p for p, s in STORE_PREFIX.items() for n in (*STORE_NAMES[s], *(("play",) if p == "play" else ()))}, F.lower(strip(store)))
    digits = F.regexp_extract(text, r"(\d+)", 1)
    body = F.when((prefix == "ios") & (digits != ""), digits).otherwise(text)
    return F.when(text != "", F.concat(F.coalesce(prefix, F.lower(text_or_blank(store))), F.lit(":"), body))


def keyed_or_numbered(store: Column, app_id: Column, number: Column) -> Column:
    """The key, or for a record without an id one made of the row's number, so that such records stay apart."""
    return F.coalesce(app_key(store, app_id), F.concat(F.lit("row:"), number.cast("string")))


def split_key(key: Column) -> tuple[Column, Column]:
    """(store, id) of a key; the store is null for an unknown prefix."""
    parts = F.split(key, ":", 2)
    store = reduce(lambda rest, p: F.when(F.get(parts, F.lit(0)) == p, F.lit(STORE_PREFIX[p])).otherwise(rest), STORE_PREFIX, F.lit(None).cast("string"))
    return store, F.get(parts, F.lit(1))


def listed(c: Column, sep: str) -> Column:
    """The parts of a delimited text, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(text_or_blank(c), sep), strip), lambda x: x != "")


def _items(literal: str | None) -> list[str] | None:
    """The strings of one list, by the language's own rules for literals, else by those of JSON."""
    if literal is None:
        return None
    for read in (ast.literal_eval, json.loads):
        try:
            got = read(literal.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
        return [x.strip().lower() for x in got if isinstance(x, str) and x.strip()] if isinstance(got, list) else None
    return None


@F.pandas_udf(ArrayType(StringType()))
def _listed_literals(c: pd.Series) -> pd.Series:
    return c.map(_items, na_action="ignore")


#: A string in either quotes without escapes and line breaks.
_QUOTED = r"""'[^'\r\n]*+'|"[^"\r\n]*+\""""


def literal_list(c: Column) -> Column:
    """The strings of a list written as a Python or JSON literal, stripped and in lower case, without empty ones; other items,
    nested lists among them, are skipped. Null if it can't be read or isn't a list.

    A flat list of strings without escapes is read natively: a quote of the other kind inside a string is part of it.
    What else there is goes to the reader of literals, in Arrow batches; it gets no text of the first kind.
    """
    shape = F.translate(F.regexp_replace(c, _QUOTED, "\x01"), " \t", "")
    plain = F.replace(shape, F.lit("\x01,"), F.lit("")).isin("[]", "[\x01]") & ~c.contains("\\") & ~c.rlike(r"[\x00\x01]")
    found = F.transform(F.regexp_extract_all(c, F.lit(_QUOTED), F.lit(0)), lambda x: F.lower(strip(x.substr(F.lit(2), F.length(x) - 2))))
    return F.when(plain, F.filter(found, lambda x: x != "")).otherwise(_listed_literals(F.when(~plain, c)))


def before_address(c: Column) -> Column:
    """The part before a comma, middle dot or line break, squeezed; numbers in it stay."""
    return squeeze(F.get(F.split(text_or_blank(c), r"[,·\n\r]"), F.lit(0)))


def developer_name(c: Column) -> Column:
    """The name before an address: first part before a comma, middle dot or line break, without a number tail and without
    a trader's note unless nothing else is left."""
    named = strip(F.regexp_replace(before_address(c), r"\s+\d{3,}.*$", ""))
    bare = strip(F.regexp_replace(named, r"^Trader\b.*", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(named, F.lit("")))


def labelled_sections(sections: dict[str, Column], most: int = 12_000) -> Column:
    """"Label: text" for each section that isn't blank, parted by blank lines, cut at ``most`` characters."""
    parts = [F.when(strip(text_or_blank(c)) != "", F.concat(F.lit(f"{name}: "), strip(text_or_blank(c)))) for name, c in sections.items()]
    return F.substring(F.concat_ws("\n\n", *parts), 1, most)


def title_case(c: Column) -> Column:
    return F.initcap(F.translate(c, "_", " "))
