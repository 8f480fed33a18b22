"""Queries for tagging, scoring, parsing, JSON and HTML."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, html, jsonx, numbers, text
from ..operators import aggregate, flatten, gates, scoring, sentiment, tagging
from .base import query, table

#: Words that occur in the corpus, as features.
WORDS = tagging.words("the", "of", "that", "with", "this", "stat")
NAMES = sorted(WORDS)
_NORM = "' ' || regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' '"
_FEATURES = "(VALUES " + ", ".join(f"('{w}')" for w in WORDS) + ") AS f(feature)"


def norm_sql(c: str) -> str:
    """The words of a text between single spaces, for DuckDB."""
    return _NORM.format(c)


@query(f"""
SELECT source, feature, count(*)::BIGINT AS hits, round(avg(n_chars), 6) AS avg_n_chars
FROM (SELECT source, n_chars, {norm_sql("text")} AS t FROM documents), {_FEATURES}
WHERE contains(t, ' ' || feature || ' ') GROUP BY source, feature
""")
def tag_hits_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = tagging.tag_counts(docs, ["source"], F.col("text"), WORDS, {"n_chars": F.col("n_chars")})
    return got.withColumn("avg_n_chars", F.round("avg_n_chars", 6))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "app_key")
    reviews = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "app_key")
    hits = tagging.tag_counts(reviews, ["app_key"], F.col("text"), WORDS).select("app_key", "feature", F.col("hits").alias("review_hits"))
    fields = {"title": F.substring("text", 1, 60), "description": F.col("text"), "metadata": F.concat_ws(" ", "lang", "source")}
    return tagging.feature_signals(docs, ["app_key"], fields, hits, WORDS)


_SIGNALS = f"""
hits AS (
  SELECT conv_id AS app_key, feature, count(*) AS n FROM (SELECT conv_id, {norm_sql("text")} AS t FROM conversations), {_FEATURES}
  WHERE contains(t, ' ' || feature || ' ') GROUP BY 1, 2),
found AS (
  SELECT doc_id AS app_key, feature, contains(title, w)::INT AS a, contains(body, w)::INT AS b, contains(meta, w)::INT AS c
  FROM (SELECT doc_id, {norm_sql("substring(text, 1, 60)")} AS title, {norm_sql("text")} AS body, {norm_sql("lang || ' ' || source")} AS meta FROM documents),
       (SELECT feature, ' ' || feature || ' ' AS w FROM {_FEATURES})),
signals AS (
  SELECT * FROM (
    SELECT f.app_key, f.feature, coalesce(n, 0)::BIGINT AS review_hits, a + b + c AS k,
      CASE WHEN a + b + c >= 2 THEN 0.8 WHEN a + b + c = 1 AND coalesce(n, 0) >= 10 THEN 0.7 WHEN a + b + c = 1 THEN 0.6 WHEN coalesce(n, 0) >= 25 THEN 0.55 ELSE 0 END::DOUBLE AS confidence,
      CASE WHEN a + b + c > 0 THEN concat_ws(',', CASE WHEN a = 1 THEN 'title' END, CASE WHEN b = 1 THEN 'description' END, CASE WHEN c = 1 THEN 'metadata' END)
           WHEN coalesce(n, 0) > 0 THEN 'reviews' ELSE '' END AS signals
    FROM found f LEFT JOIN hits h USING (app_key, feature))
  WHERE k > 0 OR confidence >= 0.55)"""


@query(f"WITH {_SIGNALS} SELECT app_key, feature, confidence, signals, review_hits FROM signals")
def confidence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


def _matrix(spark: SparkSession, sf_dir: str, value: str, how: str, fill: object) -> DataFrame:
    long = _signals(spark, sf_dir).withColumn("flag", numbers.threshold_flag(F.col("confidence"), F.col("review_hits"), 0.60, 1))
    return aggregate.matrix(long, "app_key", "feature", value, how, NAMES, fill)


def _matrix_sql(expr: str, how: str, fill: str) -> str:
    cols = ", ".join(f"coalesce({how}(CASE WHEN feature = '{n}' THEN {expr} END), {fill}) AS \"{n}\"" for n in NAMES)
    return f"WITH {_SIGNALS} SELECT app_key, {cols} FROM signals GROUP BY app_key"


@query(_matrix_sql("(confidence >= 0.6 AND review_hits >= 1)::INTEGER", "max", "0"))
def feature_matrix_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, "flag", "max", 0)


@query(_matrix_sql("confidence", "max", "0.0"))
def feature_matrix_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, "confidence", "max", 0.0)


@query(_matrix_sql("review_hits", "sum", "0").replace("coalesce(sum", "coalesce(sum").replace(", 0) AS", ", 0)::BIGINT AS"))
def feature_matrix_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, "review_hits", "sum", 0)


_W = scoring.Weights(
    include_terms=("the", "of", "with"), include_phrases=("of the", "in"), exclude_terms=("is", "was", "of then"), exclude_phrases=("is the", "on"),
    categories={"PlayStore": ("src1", "src2")}, poor_categories=("src9",), scale=400.0, fields={"title": (3.0, 1.0, 2.0), "category": (2.0, 0.8, 1.5), "description": (1.0, 0.6, 0.5)},
)
_AS_OF = dt.date(2002, 1, 1)


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cols = {"title": F.substring("text", 1, 80), "category": F.col("source"), "description": F.col("text")}
    day = F.date_add(F.lit(dt.date(1998, 1, 1)), (F.col("doc_id") % 1500).cast("int"))
    score = scoring.relevance(cols, F.lit("PlayStore"), F.col("n_chars"), F.col("doc_id"), day, _AS_OF, _W)
    return docs.select("doc_id", "source", "n_chars", cols["title"].alias("title"), F.col("text").alias("description"), score.alias("relevance_score"))


def _field_sql(c: str, w: float, t: float, e: float) -> str:
    n, low = norm_sql(c), f"lower({c})"
    spread = f"replace({low}, ' ', '  ')"  # a space for each neighbour, since a match takes its own away
    count = lambda x: f"len(list_filter(string_split({n}, ' '), lambda q: q = '{x}'))" if " " not in x else f"len(regexp_extract_all({spread}, '(^|[^\\p{{L}}\\p{{N}}_]){x.replace(' ', '  ')}($|[^\\p{{L}}\\p{{N}}_])'))"
    has = lambda p: f"regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])')::INT"
    good = f"{t} * ({' + '.join(map(count, _W.include_terms))}) + 2 * ({' + '.join(map(has, _W.include_phrases))})"
    bad = f"{e} * ({' + '.join(map(count, _W.exclude_terms))}) + {2 * e} * ({' + '.join(map(has, _W.exclude_phrases))})"
    return f"{w} * (({good}) - ({bad}))"


_BONUS = lambda x: f"CASE WHEN {x} > 0 THEN 0.18::DOUBLE * least(1.0::DOUBLE, log10({x}::DOUBLE) / 7) ELSE 0 END"
_RELEVANCE = f"""
scored AS (
  SELECT doc_id, source, n_chars, title, text,
    round(least(1.0, greatest(0.0, least(1.0, greatest(0.0, ({" + ".join(_field_sql(c, *_W.fields[f]) for f, c in (("title", "title"), ("category", "source"), ("description", "text")))})::DOUBLE / 400.0))
      + CASE WHEN source IN ('src1', 'src2') THEN 0.12 ELSE 0 END::DOUBLE - CASE WHEN contains(source, 'src9') THEN 0.08 ELSE 0 END::DOUBLE
      + {_BONUS("n_chars")} + {_BONUS("doc_id")}
      + CASE WHEN age <= 365 THEN 0.1 WHEN age >= 1095 THEN -0.1 ELSE 0 END::DOUBLE)), 3) AS relevance_score
  FROM (SELECT *, substring(text, 1, 80) AS title, date_diff('day', DATE '1998-01-01' + (doc_id % 1500)::INTEGER, DATE '2002-01-01') AS age FROM documents))"""


@query(f"WITH {_RELEVANCE} SELECT doc_id, relevance_score FROM scored")
def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir).select("doc_id", "relevance_score")


@query(f"""
WITH {_RELEVANCE}
SELECT doc_id, nullif(concat_ws(',',
  CASE WHEN length(title) < 2 THEN 'missing_title_and_description' END,
  CASE WHEN NOT (n_chars >= 3000 OR doc_id >= 900) THEN 'below_popularity_thresholds' END,
  CASE WHEN relevance_score < 0.6 THEN 'low_relevance' END), '') AS drop_reason
FROM scored
""")
def relevance_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _relevance(spark, sf_dir)
    why = gates.reasons({
        "missing_title_and_description": gates.readable(F.col("title"), F.col("description")),
        "below_popularity_thresholds": gates.popular(F.lit("PlayStore"), F.col("n_chars"), F.col("doc_id"), 3000, 900, 1e9),
        "low_relevance": gates.relevant(F.col("relevance_score"), 0.6),
    })
    return rows.select("doc_id", why.alias("drop_reason"))


@query("""
SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squeezed, length(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'))::BIGINT AS slug_length,
  substring(text, 1, 20) AS head, md5(trim(regexp_replace(regexp_replace(lower(text), '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'), '\\s+', ' ', 'g'))) AS bare
FROM documents
""")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    slug = F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", "-")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.squeeze(t)).alias("squeezed"), F.length(slug).cast("bigint").alias("slug_length"), text.cut(t, 20).alias("head"), F.md5(text.without_urls(F.lower(t))).alias("bare"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '_' || lower(p_type) AS app_id,
  CASE p_size % 3 WHEN 0 THEN 'play:' WHEN 1 THEN 'ios:' ELSE 'cws:' END || p_partkey AS app_key
FROM part
""")
def slugify_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = F.when(F.col("p_size") % 3 == 0, "android").when(F.col("p_size") % 3 == 1, "apple").otherwise("cws")
    return table(spark, sf_dir, "part").select("p_partkey", text.app_slug(F.col("p_name"), F.col("p_type")).alias("app_id"), text.app_key(store, F.col("p_partkey")).alias("app_key"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'x' WHEN s_suppkey % 3 = 1 THEN trim(s_name) ELSE trim(s_name) || '. x' END AS text
FROM supplier
""")
def compose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.compose(F.when(k == 0, " ").otherwise(F.col("s_name")), F.when(k != 1, "x")).alias("text"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_partkey * 1000 WHEN 1 THEN p_partkey * 1000000 ELSE p_partkey END::BIGINT AS n,
  (p_partkey * 1000)::BIGINT AS users, p_partkey::BIGINT AS digits
FROM part
""")
def human_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_size") % 3, F.col("p_partkey").cast("string")
    shown = F.concat(n, F.when(k == 0, "K+ downloads").when(k == 1, "M installs").otherwise("+"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.scaled(shown).alias("n"), numbers.users(F.concat(F.lit("about "), F.format_number(F.col("p_partkey") * 1000, 0), F.lit(" users"))).alias("users"), numbers.first_digits(F.concat(F.lit("v"), n, F.lit(" x"))).alias("digits"))


@query("""
SELECT p_partkey, round(least(p_retailprice, p_retailprice + p_size), 2) AS low, round(p_retailprice + p_size, 2) AS high, 2::BIGINT AS n
FROM part
""")
def price_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("In-app: $"), F.format_number("p_retailprice", 2), F.lit(" - $"), F.format_number(F.col("p_retailprice") + F.col("p_size"), 2), F.lit(" per item"))
    low, high, n = numbers.price_range(shown)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(low, 2).alias("low"), F.round(high, 2).alias("high"), n.alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS day,
  CASE WHEN o_orderkey % 4 = 3 THEN 'Flag concern' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown
FROM orders
""")
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "MMM d, yyyy")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("Flag  concern")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parsed_date(raw).alias("day"), dates.iso_or_raw(raw).alias("shown"))


@query("""
SELECT o_orderkey, CASE WHEN age <= 365 THEN 0.1 WHEN age >= 1095 THEN -0.1 ELSE 0 END::DOUBLE AS bonus
FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-09-01') AS age FROM orders)
""")
def recency_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.recency_bonus(F.col("o_orderdate").cast("date"), dt.date(2001, 9, 1)).alias("bonus"))


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(text), 'ung')) AND NOT contains(lower(text), 'licens')")
def include_exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gates.filtered_or_all(docs, gates.included(F.col("text"), ["tion", "ung"], ["Licens"])).select("doc_id")


@query("""
SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words FROM conversations
WHERE len(regexp_extract_all(text, '\\S+')) >= 20 AND length(text) >= 150
""")
def word_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(gates.long_enough(F.col("text"), 20, 150))
    return rows.select("conv_id", "turn", text.word_count(F.col("text")).alias("words"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'")
def since_days_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.where(dates.since(F.col("ts"), dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc), 10)).select("event_id", "user_id")


@query("""
SELECT event_id, (props::JSON->>'k')::BIGINT AS k, '{"k":' || (props::JSON->>'k') || ',"t":"' || event_type || '"}' AS back
FROM events
""")
def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = jsonx.parsed(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    k = jsonx.field(v, "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), jsonx.written_json(F.struct(k.alias("k"), F.col("event_type").alias("t"))).alias("back"))


@query("""
WITH r AS (SELECT event_id, event_type AS t, event_id % 6 AS k FROM events)
SELECT event_id, unnest(CASE k
  WHEN 0 THEN [{'feature': t, 'feature_norm': t, 'support': 'neutral'}, {'feature': 'Two  Words', 'feature_norm': 'two words', 'support': 'neutral'}]
  WHEN 1 THEN [{'feature': t, 'feature_norm': t, 'support': 'strong_support'}]
  WHEN 2 THEN [{'feature': t, 'feature_norm': t, 'support': 'against'}, {'feature': 'other', 'feature_norm': 'other', 'support': 'support'}]
  WHEN 3 THEN [{'feature': t, 'feature_norm': t, 'support': 'support'}]
  WHEN 4 THEN [{'feature': '', 'feature_norm': '', 'support': 'neutral'}] ELSE [] END, recursive := true)
FROM r
""")
def json_feature_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("event_id") % 6, F.col("event_type")
    made = (
        F.when(k == 0, F.concat(F.lit('["'), t, F.lit('", {"name": "Two  Words"}, 7, ""]')))
        .when(k == 1, F.concat(F.lit('{"features": [{"feature": "'), t, F.lit('", "support": "strong_support"}]}')))
        .when(k == 2, F.concat(F.lit('```json\n{"items": ["'), t, F.lit('", {"name": "other"}], "support": "support", "goldilocks_support": {"'), t, F.lit('": "against"}}\n```')))
        .when(k == 3, F.concat(F.lit('{"features": ["'), t, F.lit('"], "goldilocks_support": [{"name": "'), t, F.lit('", "label": "support"}]}')))
        .when(k == 4, '{"features": []}')
        .otherwise("not json")
    )
    rows = table(spark, sf_dir, "events").select("event_id", made.alias("features_json"))
    return flatten.flattened(rows, ["event_id"])


@query("""
SELECT event_id, feature, (event_type = feature)::INTEGER AS present, CASE WHEN event_type = feature THEN 0.9 ELSE 0 END::DOUBLE AS confidence
FROM events, (VALUES ('click'), ('view')) AS f(feature)
""")
def json_model_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit('The answer: {"'), F.col("event_type"), F.lit('": {"present": true, "confidence": 0.9}} as asked'))
    return flatten.model_flags(table(spark, sf_dir, "events").select("event_id", made.alias("a")), "a", ["event_id"], ["click", "view"])


def _decoded_sql(t: str) -> str:
    for a, b in html.ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return t


@query(f"""
SELECT page_id, trim(regexp_replace({_decoded_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title FROM pages
""")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


# in these pages only style and script are hidden, none stands in another, and no tag's attribute holds a bracket: what follows
# the n-th "<" is a tag and a text, which is shown unless more hidden elements have begun than ended
@query(r"""
WITH parts AS (SELECT page_id, unnest(string_split(coalesce(html, ''), '<')) AS part, generate_subscripts(string_split(coalesce(html, ''), '<'), 1) AS i FROM pages),
tags AS (SELECT *, lower(regexp_extract(part, '^/?[A-Za-z]+')) AS tag, strpos(part, '>') AS p FROM parts),
nested AS (SELECT *, sum(CASE WHEN i = 1 THEN 0 WHEN tag IN ('style', 'script') THEN 1 WHEN tag IN ('/style', '/script') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM tags),
texts AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN part ELSE substr(part, p + 1) END, chr(10) ORDER BY i) FILTER (depth = 0 AND CASE WHEN i = 1 THEN part <> '' ELSE p > 0 AND p < length(part) END) AS t FROM nested GROUP BY page_id),
shown AS (SELECT page_id, regexp_replace(replace(replace(replace(coalesce(t, ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM texts),
plain AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '\n{2,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM shown)
SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM plain
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = html.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://' || regexp_replace(url, '^https?://', '') END AS url,
  CASE WHEN page_id % 4 < 2 THEN lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) END AS host
FROM pages
""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("url"), F.lit("\n"))).when(k == 1, F.regexp_replace("url", "^https?://", "")).when(k == 2, "mailto:a@b.example").otherwise("localhost/x")
    rows = table(spark, sf_dir, "pages").select("page_id", html.web_url(raw).alias("url"))
    return rows.withColumn("host", F.when(F.col("url").isNotNull(), html.host(F.col("url"))))


@query("""
SELECT page_id, len(l)::BIGINT AS n_links, l[1] AS first_link
FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"''#]+)', 1) AS l FROM pages)
""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("bigint").alias("n_links"), F.get(found, F.lit(0)).alias("first_link"))


@query("""
SELECT role, label, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM (SELECT role, CASE WHEN regexp_matches(lower(text), 'good|great|love|help|focus|improve|useful|amazing|tion') THEN 'Positive'
  WHEN regexp_matches(lower(text), 'bad|bug|crash|issue|problem|hate|annoying|ing') THEN 'Negative' ELSE 'Neutral' END AS label FROM conversations)
GROUP BY role, label
""")
def keyword_sentiment_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    label = sentiment.keyword_label(F.col("text"), (*sentiment.POSITIVE, "tion"), (*sentiment.NEGATIVE, "ing"))
    return aggregate.shares(rows.select("role", label.alias("label")), ["role", "label"])


@query("""
SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z]{3,}')) AS word FROM documents)
WHERE word NOT IN ('the', 'and') GROUP BY word ORDER BY n DESC, word LIMIT 30
""")
def word_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return aggregate.word_frequencies(docs, F.col("text"), ["the", "and"]).orderBy(F.desc("n"), "word").limit(30)
