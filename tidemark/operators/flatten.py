"""JSON answers of many shapes as rows of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.numbers import support_value
from ..functions.text import feature_name, first_filled, strip

#: Columns that may hold an answer, in order (fixed values).
ANSWERS = ("features_json", "llm_json", "response_json", "json", "raw_json", "answer", "response", "model_output")


def answer_cell(df: DataFrame) -> Column:
    there = [F.col(c) for c in ANSWERS if c in df.columns]
    return first_filled(*there) if there else F.lit(None).cast("string")


def features_of(v: Column) -> Column:
    """The features of an answer as (name, support or null): a bare list, or the list under features or items; elements are
    names or objects."""
    items = F.when(jsonx.kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))
    items = items.when(jsonx.kind(F.try_variant_get(v, "$.features", "variant")) == "array", F.try_variant_get(v, "$.features", "array<variant>"))
    items = items.when(jsonx.kind(F.try_variant_get(v, "$.items", "variant")) == "array", F.try_variant_get(v, "$.items", "array<variant>"))
    items = items.otherwise(F.array().cast("array<variant>"))

    def one(x: Column) -> Column:
        text = F.when(jsonx.kind(x) == "string", F.nullif(strip(jsonx.field(x, "$")), F.lit("")))
        named = F.when(jsonx.kind(x) == "object", jsonx.first_field(x, "name", "feature", "feature_name"))
        return F.coalesce(text, named)

    return F.filter(F.transform(items, one), lambda f: f.isNotNull())


def support_pairs(v: Column) -> Column:
    """(normal name, label) pairs of an answer, in rising precedence: an object or a list under goldilocks_support, then
    labels inside the list of features."""

    def pair(x: Column, names: tuple[str, ...], labels: tuple[str, ...]) -> Column:
        return F.struct(feature_name(jsonx.first_field(x, *names)).alias("name"), jsonx.first_field(x, *labels).alias("label"))

    empty = F.array().cast("array<struct<name:string,label:string>>")
    table = F.try_variant_get(v, "$.goldilocks_support", "map<string,string>")
    of_map = F.transform(F.map_entries(table), lambda e: F.struct(feature_name(e["key"]).alias("name"), F.coalesce(F.nullif(strip(e["value"]), F.lit("")), F.lit("neutral")).alias("label")))
    of_list = F.transform(F.try_variant_get(v, "$.goldilocks_support", "array<variant>"), lambda x: pair(x, ("feature", "name", "feature_name"), ("label", "support")))
    inline = F.transform(F.try_variant_get(v, "$.features", "array<variant>"), lambda x: pair(x, ("name", "feature", "feature_name"), ("support", "label")))
    every = F.concat(F.coalesce(of_map, empty), F.coalesce(of_list, empty), F.coalesce(inline, empty))
    return F.filter(every, lambda p: (p["name"] != "") & p["label"].isNotNull())


def support_of(pairs: Column, name: Column, overall: Column) -> Column:
    """The last label given to the feature, else the overall one, else neutral."""
    own = F.filter(pairs, lambda p: p["name"] == name)
    return F.coalesce(F.try_element_at(own, F.lit(-1))["label"], F.nullif(strip(overall), F.lit("")), F.lit("neutral"))


def flattened(df: DataFrame, carry: list[str]) -> DataFrame:
    """A row per feature of each answer: ``carry``, feature, feature_norm, support. An answer without features gives one
    row with a blank feature; a cell that isn't JSON gives none."""
    rows = df.select(*carry, jsonx.parsed(answer_cell(df)).alias("v")).where("v is not null")
    overall = F.when(jsonx.kind(F.try_variant_get("v", "$.support", "variant")) == "string", jsonx.field(F.col("v"), "$.support"))
    rows = rows.select(*carry, features_of(F.col("v")).alias("f"), support_pairs(F.col("v")).alias("p"), overall.alias("g"))
    one = rows.select(*carry, "p", "g", F.explode(F.when(F.size("f") > 0, F.col("f")).otherwise(F.array(F.lit("")))).alias("feature"))
    norm = feature_name(F.col("feature"))
    support = F.when(F.col("feature") == "", F.lit("neutral")).otherwise(support_of(F.col("p"), norm, F.col("g")))
    return one.select(*carry, "feature", norm.alias("feature_norm"), support.alias("support"))


def taxonomy_rows(df: DataFrame, answer: str, carry: list[str]) -> DataFrame:
    """A row per typed taxonomy feature: feature_name (100 signs at most), category, support, support_val, nd_specific,
    evidence."""
    schema = "features array<struct<name:string,category:string,support:string,nd_specific:boolean,evidence:string>>"
    got = F.from_json(jsonx.unfenced(F.col(answer)), schema)
    rows = df.select(*carry, F.inline(got["features"]))
    blank = lambda c, d: F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit(d))
    return rows.select(
        *carry, F.substring(blank("name", ""), 1, 100).alias("feature_name"), blank("category", "").alias("category"), blank("support", "neutral").alias("support"),
        support_value(F.col("support")).alias("support_val"), F.coalesce("nd_specific", F.lit(False)).alias("nd_specific"), blank("evidence", "").alias("evidence"),
    )


def model_flags(df: DataFrame, answer: str, carry: list[str], features: list[str]) -> DataFrame:
    """A row per record and known feature: present (0 or 1) and confidence, zeros where the answer has none."""
    rows = df.select(*carry, jsonx.parsed_answer(F.col(answer)).alias("v"))

    def one(f: str) -> Column:
        present = F.coalesce(jsonx.field(F.col("v"), f"$.{f}.present", "int"), jsonx.field(F.col("v"), f"$.{f}.present", "boolean").cast("int"), F.lit(0))
        return F.struct(F.lit(f).alias("feature"), present.alias("present"), F.coalesce(jsonx.field(F.col("v"), f"$.{f}.confidence", "double"), F.lit(0.0)).alias("confidence"))

    return rows.select(*carry, F.inline(F.array(*(one(f) for f in features))))
