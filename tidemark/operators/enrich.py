"""Texts through an external model: prompts as Columns, calls in Pandas batches with an injected client, failures as rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.text import cut, labelled_sections, listed
from . import calls, flatten, joins

Client = Callable[[str], str]
#: What an answer is when the call fails.
STUB = json.dumps({"features": [], "support": "neutral"})


def prompt(task: str, sections: dict[str, Column], caps: dict[str, int] | None = None) -> Column:
    """The task, then the labelled sections, each cut at its cap."""
    parts = {name: cut(c, (caps or {}).get(name, 4000)) for name, c in sections.items()}
    return F.concat(F.lit(task.strip() + "\n\n"), labelled_sections(parts))


def answered(df: DataFrame, prompt_col: str, client: Client | None, stub: str = STUB, pause: float = 0.0, attempts: int = 1) -> DataFrame:
    """With the columns ``answer`` and ``failed``. Without a client (no key) nothing is asked and every answer is the stub.

    The client is pickled to the tasks; a batch's repeated prompts are asked once, ``pause`` seconds apart, and up to ``attempts``
    times with pauses that double; the last exception is that row's failure. ``calls.paced`` keeps a pace over all tasks.
    """
    if client is None:
        return df.withColumns({"answer": F.lit(stub), "failed": F.lit(True)})
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("failed", T.BooleanType())])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: dict[str, tuple[str, bool]] = {}
            for p in f[prompt_col].unique():
                try:
                    seen[p] = (calls.retried(lambda p=p: client(p), attempts, max(pause, 0.1)), False)
                except Exception:  # the provider's failures are data here
                    seen[p] = (stub, True)
                if pause:
                    time.sleep(pause)
            yield f.assign(answer=[seen[p][0] for p in f[prompt_col]], failed=[seen[p][1] for p in f[prompt_col]])

    return df.mapInPandas(ask, schema)


def client_for(spec: str, makers: dict[str, Callable[[str], Client]]) -> Client:
    """A client from "vendor:model"."""
    vendor, _, model = spec.partition(":")
    if vendor not in makers:
        raise ValueError(f"unknown vendor: {vendor}")
    return makers[vendor](model)


#: What is asked, in our own words, and how much of each section is sent: {name: (task, {section: characters})}.
TEMPLATES = {
    "classify": ('Name the subject of this text. Answer with one JSON object {"label": text, "confidence": number from 0 to 1}.', {"Text": 6000}),
    "features": (
        'List the features of this app and whether they support its users\' focus. Answer with one JSON object {"features": [{"name": text, "support": text}], "support": text}.',
        {"Title": 200, "Description": 4000, "Website": 4000, "Reviews": 3000},
    ),
    "taxonomy": (
        'Sort this app\'s features. Answer with one JSON object {"features": [{"name": text, "category": text, "support": "supportive" or "neutral" or "undermining", "nd_specific": boolean, "evidence": text}]}.',
        {"Title": 200, "Description": 6000, "Website": 5000},
    ),
    "flags": (
        'Say for each feature whether the app has it. Answer with one JSON object {feature: {"present": 0 or 1, "confidence": number from 0 to 1}}.',
        {"Features": 2000, "Title": 200, "Description": 4000, "Website": 4000},
    ),
    "reviews": ('What does this review say? Answer with one JSON object {"type": "pain" or "praise" or "unmet" or "other", "aspects": [text]}.', {"Review": 2000}),
    "summary": ("Sum up what these reviews have in common, in three sentences.", {"Title": 200, "Reviews": 8000}),
}
#: What an answer is when nothing could be asked, where it isn't ``STUB``.
STUBS = {"classify": "{}", "taxonomy": '{"features": []}', "flags": "{}", "reviews": "{}", "summary": ""}


def templated(name: str, sections: dict[str, Column]) -> Column:
    """The prompt of a template; only sections that it has are allowed."""
    task, caps = TEMPLATES[name]
    if unknown := set(sections) - set(caps):
        raise ValueError(f"no such section of {name}: {', '.join(sorted(unknown))}")
    return prompt(task, sections, caps)


def classes(df: DataFrame, answer: str, carry: list[str]) -> DataFrame:
    """label and confidence of each answer; nulls where it has none."""
    v = jsonx.parsed_answer(F.col(answer))
    return df.select(*carry, jsonx.first_field(v, "label").alias("label"), jsonx.field(v, "$.confidence", "double").alias("confidence"))


def review_labels(df: DataFrame, answer: str, carry: list[str]) -> DataFrame:
    """type and aspects (joined by semicolons) of each answer; aspects may be a list or one delimited text."""
    v = jsonx.parsed_answer(F.col(answer))
    aspects = F.coalesce(F.try_variant_get(v, "$.aspects", "array<string>"), listed(jsonx.field(v, "$.aspects"), ";"))
    return df.select(*carry, jsonx.first_field(v, "type").alias("type"), F.coalesce(F.array_join(aspects, "; "), F.lit("")).alias("aspects"))


def enriched(name: str, todo: DataFrame, keys: list[str], sections: dict[str, Column], client: Client | None, done: DataFrame | None = None, features: list[str] = (), pause: float = 0.0) -> DataFrame:
    """Rows that aren't in ``done`` yet, asked with a template and parsed: its columns and ``failed``, a row per answer or per
    feature in it."""
    rows = todo if done is None else joins.not_done(todo, done, keys)
    asked = answered(rows.select(*keys, templated(name, sections).alias("prompt")), "prompt", client, STUBS.get(name, STUB), pause)
    carry = [*keys, "failed"]
    if name == "features":
        return flatten.flattened(asked, carry)
    if name == "summary":
        return asked.select(*carry, "answer")
    if name == "flags":
        return flatten.model_flags(asked, "answer", carry, list(features))
    return {"classify": classes, "taxonomy": flatten.taxonomy_rows, "reviews": review_labels}[name](asked, "answer", carry)
