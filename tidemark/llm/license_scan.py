"""Licence scans by canonical digest lookup, in DataFrame operations only.

A text is made canonical: lower case; lines that only state a copyright go; punctuation, symbols and white space become
single spaces; equivalent spellings become one. Only real statements go (a copyright with a sign, a year or a place for
one, or with all rights reserved), never lines of a licence's body that happen to begin with the word, and spellings
count as equal also over the end of a line: a match doesn't depend on where a text is wrapped.

The digest of the whole canonical text is joined with the digests of known licence texts; each line is looked up in the same way among known one-line notices. A match means that the entire
text (or the entire line) is that licence; a text that merely quotes a part of one doesn't match.

Nulls and empty texts have the digest of no text and match nothing. A text, however long, is only rewritten by expressions
where it is read, never split over tasks or shuffled. Each row is scanned by itself: repeated rows and
null ids stay as they are. An empty table gives an empty table. Columns that aren't named are not read. The table of
known digests has a row per known text; a caller can add texts of their own, and it is broadcast as long as a count shows
it to be small.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import sized_join, written
from .license_texts import NOTICES, SPELLINGS, TEXTS, full_texts

_YEAR = r"(\d{4}|[\[<{(]\s?(yyyy|year|xxxx|date|dates)\b)"
#: Lines that state a copyright and nothing else that a licence says: with a sign, a year or a place for one, or all rights reserved.
COPYRIGHT = rf"^[ \t]*(copyright[ \t:]*(\(c\)|©|&copy;|{_YEAR})[^\n]*|copyright\b[^\n]*\ball rights reserved[^\w\n]*|(\(c\)|©)[ \t]*(copyright\b|{_YEAR})[^\n]*|all rights reserved[^\w\n]*)$"
#: All that isn't part of a word, on one line.
BETWEEN = r"[\x00-\x09\x0B-\x20\p{P}\p{S}\p{Z}]+"
KNOWN = "kind string, digest string, length int, license string"
_ONE = {a: b for a, b in SPELLINGS}


def plain(text: Column) -> Column:
    """Lower case without copyright lines, words parted by single spaces or line feeds."""
    out = F.regexp_replace(F.lower(text), "(?dm)" + COPYRIGHT, "")
    return F.regexp_replace(out, BETWEEN, " ")


def respelled(c: Column) -> Column:
    """The canonical form of a plain text. Most texts have no variant at all, which one search tells."""
    out = c
    for variant, word in _ONE.items():
        # look-arounds take no space away from the next variant
        out = F.regexp_replace(out, rf"(?<![^ \n]){re.escape(variant)}(?![^ \n])", word)
    return F.when(c.rlike("|".join(map(re.escape, _ONE))), out).otherwise(c)


def canonical(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Columns ``keep`` and the canonical form ``c``, still with its line feeds."""
    return df.select(*keep, plain(text).alias("p")).select(*keep, respelled(F.col("p")).alias("c"))


def one_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \n]+", " "), r"^ | $", "")


def unwrapped(c: Column) -> Column:
    """A canonical form on one line, with the spellings that the end of a line had parted."""
    return respelled(one_line(c))


def known_digests(known: DataFrame) -> DataFrame:
    """(kind, digest, length, license) of known texts and notices, (kind, license, text). Nulls and empty texts are none."""
    got = canonical(known.where("text is not null and license is not null"), F.col("text"), "kind", "license")
    got = got.select("kind", "license", unwrapped(F.col("c")).alias("c")).where("c <> ''")
    return got.groupBy("kind", F.sha2("c", 256).alias("digest"), F.length("c").alias("length")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known_texts: DataFrame | None = None) -> DataFrame:
    """One row per document: id, canonical_sha256, license (of the entire text or null), notices (sorted licences of its
    notice lines, joined by commas, or null), n_notice_lines.

    ``known_texts``: whole texts (license, text) that are known besides the shipped ones. Of licences with equal
    canonical texts the first by name is given.
    """
    spark = docs.sparkSession
    shipped = [("text", name, t) for name, t in [*TEXTS, *full_texts()]] + [("line", name, t) for name, t in NOTICES]
    # a row per shipped text
    known = spark.createDataFrame(known_digests(spark.createDataFrame(shipped, "kind string, license string, text string")).collect(), KNOWN)
    texts = known.where("kind = 'text'").select("digest", "license")
    if known_texts is not None:
        more = known_digests(known_texts.select(F.lit("text").alias("kind"), F.col("license").cast("string").alias("license"), "text"))
        texts = written(texts.unionByName(more.select("digest", "license")).groupBy("digest").agg(F.min("license").alias("license")), "known")
    longest = max(len(t) for _, t in NOTICES) + 64  # canonical notices are no longer than this; longer lines can't match
    rows = canonical(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.coalesce("text", F.lit("")), "id")
    lines = F.transform(F.split("c", "\n"), lambda x: F.trim(x))
    brief = F.filter(lines, lambda x: (F.length(x) <= longest) & (x != ""))
    notices = known.where("kind = 'line'").select("digest", "license")
    rows = rows.select("id", F.sha2(unwrapped(F.col("c")), 256).alias("digest"), F.transform(brief, lambda x: F.sha2(x, 256)).alias("lines"))
    # a row's few lines are looked up in place, in a literal map of the fixed notices
    pairs = [F.lit(x) for r in notices.collect() for x in (r["digest"], r["license"])]
    table = F.create_map(*pairs)
    rows = rows.withColumn("hits", F.filter(F.transform("lines", lambda d: F.element_at(table, d)), lambda x: x.isNotNull()))
    out = sized_join(rows, texts, ["digest"], "left")
    found = F.array_join(F.array_sort(F.array_distinct("hits")), ",")
    return out.select("id", F.col("digest").alias("canonical_sha256"), "license", F.when(found != "", found).alias("notices"), F.size("hits").cast("long").alias("n_notice_lines"))


def _duck(text: str) -> str:
    out = f"regexp_replace(lower({text}), '(?m){COPYRIGHT}', '', 'g')"
    out = f"regexp_replace({out}, '{BETWEEN}', ' ', 'g')"
    return _duck_respelled(out)


def _duck_respelled(out: str) -> str:
    """Without look-arounds: white space is doubled, so that each word has its own at both ends."""
    out = f"replace(replace({out}, ' ', '  '), chr(10), chr(10) || chr(10))"
    for variant, word in _ONE.items():
        out = f"regexp_replace({out}, '(^|[ \\n]){variant.replace(' ', '  ')}($|[ \\n])', '\\1{word.replace(' ', '  ')}\\2', 'g')"
    return f"replace(replace({out}, '  ', ' '), chr(10) || chr(10), chr(10))"


def oracle() -> str:
    """The same for DuckDB, over ``documents``; the long licences are left out, which no document of the tables has."""

    def quoted(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"

    values = ", ".join(f"('{kind}', '{name}', {quoted(t)})" for kind, rows in (("text", TEXTS), ("line", NOTICES)) for name, t in rows)
    flat = lambda c: f"regexp_replace(regexp_replace({c}, '[ \\n]+', ' ', 'g'), '^ | $', '', 'g')"
    whole = lambda c: _duck_respelled(flat(c))
    return f"""
WITH known AS (
  SELECT kind, sha256(c) AS digest, min(license) AS license
  FROM (SELECT kind, license, {whole(_duck("text"))} AS c FROM (VALUES {values}) AS v(kind, license, text)) GROUP BY 1, 2),
canon AS (SELECT doc_id, {_duck("coalesce(text, '')")} AS c FROM documents),
lines AS (SELECT doc_id, sha256(trim(line)) AS digest FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS line FROM canon)),
hits AS (
  SELECT doc_id, count(*)::BIGINT AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM lines JOIN known USING (digest) WHERE kind = 'line' GROUP BY doc_id)
SELECT canon.doc_id, sha256({whole("canon.c")}) AS canonical_sha256, known.license, hits.notices, coalesce(hits.n, 0)::BIGINT AS n_notice_lines
FROM canon LEFT JOIN known ON known.kind = 'text' AND known.digest = sha256({whole("canon.c")})
LEFT JOIN hits USING (doc_id)
"""
