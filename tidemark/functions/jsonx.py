"""JSON of unknown shape as VARIANT expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut, strip, text_or_blank


def unfenced(c: Column) -> Column:
    """Without a code fence around the text."""
    return strip(F.regexp_replace(strip(text_or_blank(c)), r"^```[A-Za-z]*\s*|\s*```$", ""))


def parsed(c: Column) -> Column:
    """A VARIANT, or null where the text isn't JSON."""
    return F.try_parse_json(F.nullif(unfenced(c), F.lit("")))


def parsed_answer(c: Column) -> Column:
    """A model's answer as VARIANT: the fenced or bare object, else the span from the first to the last brace, else an
    object that holds the answer's beginning."""
    span = F.nullif(F.regexp_extract(text_or_blank(c), r"(?s)(\{.*\})", 1), F.lit(""))
    stub = F.parse_json(F.to_json(F.struct(cut(c, 2000).alias("raw_text"))))
    return F.coalesce(parsed(c), F.try_parse_json(span), stub)


def kind(v: Column) -> Column:
    """array, object, string, number or null."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "STRING", "string").when(s.isNull() | (s == "VOID"), "null").otherwise("number")


def field(v: Column, path: str, as_type: str = "string") -> Column:
    return F.try_variant_get(v, path, as_type)


def first_field(v: Column, *names: str) -> Column:
    """The first of the fields that isn't missing or blank."""
    return F.coalesce(*(F.nullif(strip(field(v, f"$.{n}")), F.lit("")) for n in names))


def as_list(v: Column) -> Column:
    """An array of VARIANT from an array, or from a single value as an array of one."""
    return F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v))


def label(v: Column, path: str, default: str = "") -> Column:
    """A nested label, or the default where a level is missing."""
    return F.coalesce(field(v, path), F.lit(default))


def written_json(c: Column) -> Column:
    return F.to_json(c)
