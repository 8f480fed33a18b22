"""Queries that run the market pipeline's own plans with their real tables: catalog, features, cards, store pages, reviews.

Inputs are made from the tables' columns. What is expected of their texts is stated by hand in the SQL (which features a
phrase shows, what it scores), not computed by the same patterns.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import aggregate, ordering, scoring, sentiment, tagging
from ..sources import sinks, stores
from . import market
from .base import query, shared, table

_AS_OF = dt.date(2025, 1, 1)


def _case(key: Column, *values: str | None) -> Column:
    """The value of this number, by position."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), key.cast("int") + 1)


def _raw(spark: SparkSession, sf_dir: str, twice: bool = False) -> DataFrame:
    """Raw records under aliased names, with numbers, prices and dates as people write them."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        _case(F.col("p_size") % 3, "android", "ios", "cws").alias("store"), F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("id"), k)).otherwise(k.cast("string")).alias("package"),
        F.when(k % 16 != 7, F.col("p_name")).alias("name"), _case(k % 4, "PRODUCTIVITY", "Education", "games pack", None).alias("genre"), F.col("p_brand").alias("seller"),
        (F.col("p_size") / 10).cast("string").alias("score"), F.col("p_size").cast("string").alias("ratings"), F.concat(F.format_number(k * 10, 0), F.lit("+ downloads")).alias("installs"),
        F.lit("$0.99 - $1,004.50 per item").alias("pricing_raw"), F.when(k % 5 == 0, F.lit("2.5")).alias("iap_min"), _case(k % 3, "2024-06-01", "Jan 5, 2020", "Flag concern").alias("updated"),
        F.lit(None).cast("string").alias("description_full"), _case(k % 4, "A focus timer for deep work", "wallpaper and themes", "blockchain study timers", None).alias("summary"), F.lit("2024-01-01").alias("scrapedAt"),
    )
    return rows.unionByName(rows.withColumns({"scrapedAt": F.lit("2024-02-01"), "ratings": (F.col("ratings").cast("int") * 3).cast("string")})) if twice else rows


_CATALOG = """
raw AS (
  SELECT p_partkey AS k, p_size AS s, CASE p_size % 3 WHEN 0 THEN 'PlayStore' WHEN 1 THEN 'AppStore' ELSE 'ChromeWS' END AS store, CASE WHEN p_partkey % 16 <> 7 THEN p_name END AS title,
    CASE p_partkey % 4 WHEN 0 THEN 'PRODUCTIVITY' WHEN 1 THEN 'Education' WHEN 2 THEN 'games pack' END AS category, p_size * TIMES AS ratings FROM part),
scored AS (
  SELECT *, least(1.0, greatest(0.0, (
      -6 * len(list_filter(string_split(coalesce(title, ''), ' '), lambda w: w = 'widget')) + CASE k % 4 WHEN 0 THEN 1.6 + 5.8 WHEN 1 THEN -0.5 WHEN 2 THEN 0.6 ELSE 0 END)::DOUBLE / 7))
    + CASE WHEN (store = 'PlayStore' AND category = 'PRODUCTIVITY') OR (store <> 'PlayStore' AND category = 'Education') THEN 0.12 ELSE 0 END::DOUBLE - CASE WHEN k % 4 = 2 THEN 0.08 ELSE 0 END::DOUBLE
    + 0.18::DOUBLE * log10(ratings::DOUBLE) / 7 + CASE WHEN k > 0 THEN 0.18::DOUBLE * least(1.0, log10(k * 10.0) / 7) ELSE 0 END + CASE k % 3 WHEN 0 THEN 0.1 WHEN 1 THEN -0.1 ELSE 0 END::DOUBLE AS total FROM raw),
catalog AS (
  SELECT k, CASE store WHEN 'PlayStore' THEN 'play:' WHEN 'AppStore' THEN 'ios:' ELSE 'cws:' END || k AS app_key, store, title, category, ratings, k * 10 AS installs, round(least(1.0, greatest(0.0, total)), 3) AS relevance_score FROM scored)"""


@query(f"""
WITH {_CATALOG.replace("TIMES", "1")}
SELECT app_key, catalog.store, title, category, p_brand AS developer, p_size / 10.0::DOUBLE AS rating_avg, ratings::BIGINT AS rating_count, installs::BIGINT AS installs_or_users,
  CASE WHEN k % 5 = 0 THEN 2.5 ELSE 0.99 END::DOUBLE AS iap_min, CASE WHEN k % 5 = 0 THEN NULL ELSE 1004.5 END::DOUBLE AS iap_max, CASE k % 3 WHEN 0 THEN DATE '2024-06-01' WHEN 1 THEN DATE '2020-01-05' END AS last_update,
  CASE k % 4 WHEN 0 THEN 'A focus timer for deep work' WHEN 1 THEN 'wallpaper and themes' WHEN 2 THEN 'blockchain study timers' END AS description,
  regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '_' || lower(catalog.store) AS app_id, relevance_score
FROM catalog JOIN part ON p_partkey = k
""")
def catalog_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = market.normalized(_raw(spark, sf_dir), _AS_OF)
    return got.select("app_key", "store", "title", "category", "developer", "rating_avg", "rating_count", "installs_or_users", "iap_min", "iap_max", "last_update", "description", "app_id", "relevance_score")


@query(f"""
WITH {_CATALOG.replace("TIMES", "3")}
SELECT app_key, ratings::BIGINT AS rating_count, nullif(concat_ws(',',
  CASE WHEN title IS NULL AND k % 4 = 3 THEN 'missing_title_and_description' END,
  CASE WHEN NOT (ratings >= 50 OR (store = 'PlayStore' AND installs >= 10000) OR (store = 'ChromeWS' AND installs >= 1000)) THEN 'below_popularity_thresholds' END,
  CASE WHEN relevance_score < 0.2 THEN 'low_relevance' END), '') AS drop_reason
FROM catalog
""")
def catalog_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each app is there twice; the later scrape has three times the ratings."""
    return market.checked(market.normalized(_raw(spark, sf_dir, twice=True), _AS_OF)).select("app_key", "rating_count", "drop_reason")


_TITLES = ("Pomodoro timer", "Site blocker", "Habits", "Family", "Notes", "Calendar sync", "ADHD tools", None)
_DESCRIPTIONS = ("Work sessions, then a long break", "Blocks porn. No whitelist", "Streaks and routines with badges", "Parental controls with downtime", "Nothing here", "Cross-device to-do lists", "White noise, focus music", None)
_SAID = ("great TIMER", "Snooze the ALARM", None, "weekly report, nice charts", "x", "an add-on", "earn coins")


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("play:"), "p_partkey").alias("app_key"), F.lit("PlayStore").alias("store"), _case(k, *_TITLES).alias("title"), _case(k, *_DESCRIPTIONS).alias("description"),
        F.when(k == 3, "Kids").otherwise("tools").alias("category"), F.col("p_brand").alias("developer"), k.alias("k"),
    )


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = _apps(spark, sf_dir)
    sites = apps.where("k in (0, 4)").select("app_key", F.when(F.col("k") == 0, "Countdown").otherwise("A dashboard of trends").alias("website_text"))
    line = F.col("l_linenumber") - 1
    said = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("play:"), F.col("l_partkey") % 200).alias("app_key"), _case(line, *_SAID).alias("body"), F.when(line == 2, "blocker").alias("title"))
    return market.features_long(apps.drop("k"), sites, said)


_LONG = """
shown(k, feature, n, signals) AS (VALUES
  (0, 'pomodoro', 2, 'title,description'), (0, 'timer', 3, 'title,description,website'), (1, 'blocking', 2, 'title,description'), (1, 'whitelist_blacklist', 1, 'description'), (2, 'habit_tracking', 2, 'title,description'),
  (2, 'gamification', 1, 'description'), (2, 'scheduling', 1, 'description'), (3, 'parental_control', 2, 'description,metadata'), (3, 'screen_time', 1, 'description'), (3, 'scheduling', 1, 'description'),
  (4, 'analytics', 1, 'website'), (5, 'calendar_integration', 1, 'title'), (5, 'cross_device_sync', 2, 'title,description'), (5, 'todo_integration', 1, 'description'), (6, 'adhd_support', 1, 'title'), (6, 'focus_music_noise', 1, 'description')),
said(line, feature) AS (VALUES (1, 'timer'), (2, 'reminders'), (3, 'blocking'), (4, 'analytics'), (6, 'browser_extension'), (6, 'adhd_support'), (7, 'rewards')),
hits AS (SELECT l_partkey % 200 AS p, feature, count(*) AS n FROM lineitem JOIN said ON line = l_linenumber GROUP BY 1, 2),
found AS (SELECT p_partkey AS p, feature, n, signals FROM part JOIN shown ON k = p_partkey % 8),
every AS (SELECT coalesce(f.p, h.p) AS p, coalesce(f.feature, h.feature) AS feature, coalesce(f.n, 0) AS k, f.signals, coalesce(h.n, 0) AS hits FROM found f FULL JOIN hits h ON f.p = h.p AND f.feature = h.feature),
long AS (
  SELECT p, feature, CASE WHEN k >= 2 THEN 0.8 WHEN k = 1 AND hits >= 10 THEN 0.7 WHEN k = 1 THEN 0.6 ELSE 0.55 END::DOUBLE AS confidence, CASE WHEN k > 0 THEN signals ELSE 'reviews' END AS signals, hits
  FROM every WHERE (k > 0 OR hits >= 25) AND p IN (SELECT p_partkey FROM part))"""


@query(f"WITH {_LONG} SELECT 'play:' || p AS app_key, feature, confidence, signals, hits::BIGINT AS review_hits, (confidence >= 0.6 AND hits >= 5)::INTEGER AS flag FROM long")
def features_long_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir)


@query(f"""
WITH {_LONG}, t AS (SELECT *, list_extract({[t for t in _TITLES if t]!r}, (p % 8 + 1)::INT) AS title FROM long WHERE p % 8 < 7)
SELECT place::INTEGER AS place, app_key, feature FROM (
  SELECT row_number() OVER (ORDER BY confidence DESC, hits DESC, title, 'play:' || p, feature) AS place, 'play:' || p AS app_key, feature FROM t) WHERE place <= 40
""")
def surest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the three-way mixed sort, with their places."""
    rows = _long(spark, sf_dir).join(_apps(spark, sf_dir).select("app_key", "title"), "app_key").where("title is not null")
    by = [*ordering.ordering(*ordering.SUREST), F.col("app_key").asc(), F.col("feature").asc()]
    from pyspark.sql import Window as W

    top = ordering.capped(rows, 40, by)
    return top.withColumn("place", F.row_number().over(W.orderBy(*by))).select("place", "app_key", "feature")  # forty rows


@query("""
SELECT choice, p_partkey FROM (
  SELECT 'Rating (high to low)' AS choice, p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part UNION ALL
  SELECT 'installs, lowest first', p_partkey, row_number() OVER (ORDER BY p_partkey * 10, p_partkey) FROM part UNION ALL
  SELECT 'whatever', p_partkey, row_number() OVER (ORDER BY p_partkey) FROM part) WHERE r <= 15
""")
def chosen_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("rating_avg"), F.concat(F.format_number(F.col("p_partkey") * 10, 0), F.lit("+")).alias("installs_or_users"))
    parts = [ordering.capped(rows, 15, ordering.chosen_order(c, ["p_partkey"])).select(F.lit(c).alias("choice"), "p_partkey") for c in ("Rating (high to low)", "installs, lowest first", "whatever")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH w AS (SELECT doc_id, quality, toxic, (n_chars > 1500)::INT AS size, CASE WHEN doc_id % 3 > 0 THEN (n_chars > 1000)::INT END AS human FROM labels JOIN documents USING (doc_id)),
p AS (SELECT 'long' AS rater_a, size AS a, human AS b FROM w UNION ALL SELECT 'quality', quality, human FROM w UNION ALL SELECT 'toxic', toxic, human FROM w)
SELECT rater_a, 'human' AS rater_b, round((po - pe) / (1 - pe), 3) AS kappa, n FROM (
  SELECT rater_a, count(*)::BIGINT AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM p WHERE b IS NOT NULL GROUP BY 1)
""")
def human_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raters against human labels, which two thirds of the items have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    long = rows.select("doc_id", "quality", "toxic", (F.col("n_chars") > 1500).cast("int").alias("long")).unpivot(["doc_id"], ["quality", "toxic", "long"], "model", "present")
    human = docs.where("doc_id % 3 > 0").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("present"))
    return aggregate.human_agreement(long, human, ["doc_id"], "model", "present")


_SPECIAL = ("an ND-friendly app", "dyscalculia", "my Tourette's", "sensory  processing", "executive functioning", "addition, asdf", "Neurodiversity!", "AuDHD", "nothing", None, "I add", "autistic", "dyspraxia", "dyslexic", "Asperger")


@query("SELECT p_partkey, p_partkey % 15 NOT IN (5, 8, 9) AS special FROM part")
def special_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _case(F.col("p_partkey") % 15, *_SPECIAL)
    odd = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", tagging.neurodiverse(F.when(odd, said), F.when(~odd, said)).alias("special"))


#: A text and the sum of its words' weights by hand, before it is scaled.
_MOODS = (
    ("I love it", 3.0), ("not good", 2.0 * -0.74), ("a VERY good app", 2.0 + 0.293), ("good!!", 2.0 + 2 * 0.292), ("never a really bad crash", (-2.0 - 0.293 * 0.95 * 0 - 0.293) * -0.74 + (-2.0 - 0.293 * 0.95) * 1.0),
    ("table", 0.0), (None, 0.0), ("bad!!!!!!", -2.0 - 4 * 0.292), ("it isn't so great", (3.0 + 0.293) * -0.74),
)


@query("WITH m(k, s) AS (VALUES " + ", ".join(f"({i}, {s!r}::DOUBLE)" for i, (_, s) in enumerate(_MOODS)) + ") SELECT p_partkey, round(s / sqrt(s * s + 15), 4) AS score FROM part JOIN m ON k = p_partkey % 9")
def valence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sentiment.engine("vader")(_case(F.col("p_partkey") % 9, *(t for t, _ in _MOODS))).alias("score"))


@query("""
SELECT p_partkey, round(least(1.0, greatest(0.0, greatest(0, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 - 2 WHEN 2 THEN 1 - 4 ELSE 0 END) / 5.0::DOUBLE
  + CASE WHEN p_size * 400 >= 10000 THEN 0.1 WHEN p_size * 400 >= 1000 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN p_partkey * 10000 >= 10000000 THEN 0.1 WHEN p_partkey * 10000 >= 1000000 THEN 0.05 ELSE 0 END::DOUBLE)), 3) AS score
FROM part
""")
def simple_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older score counts substrings: "timers" and "blockchain" count."""
    title, body = _case(F.col("p_partkey") % 4, "Focus timers", "timer TIMERS", "focus", None), _case(F.col("p_partkey") % 4, "blockchain", "a game", "games game", "")
    return table(spark, sf_dir, "part").select("p_partkey", scoring.simple_relevance([title, body], F.col("p_size") * 400, F.col("p_partkey") * 10000, ["focus", "timer", "block"], ["game"]).alias("score"))


def _mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of each (app, country): apps are customers, countries are priorities."""
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("play:"), "o_custkey").alias("app_key"), F.col("o_orderpriority").alias("country")).agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("o_orderstatus") == "F").alias("n_nd"), F.avg(F.col("o_orderkey") % 5).alias("avg_rating"),
        F.avg(F.col("o_orderkey") % 3 - 1).alias("mean_compound"), F.avg((F.col("o_orderkey") % 3 == 2).cast("int")).alias("pct_positive"), F.avg((F.col("o_orderkey") % 3 == 0).cast("int")).alias("pct_negative"),
    ).withColumn("store", F.lit("PlayStore"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("play:"), "o_custkey").alias("app_key"), F.concat(F.lit("f"), F.lower("o_orderstatus")).alias("feature"), (F.col("o_orderkey") % 2).cast("int").alias("flag"))
    return rows.groupBy("app_key", "feature").agg(F.max("flag").alias("flag"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("play:"), "c_custkey").alias("app_key"), F.lit("PlayStore").alias("store"), F.col("c_name").alias("title"))


_COUNTRIES = """
per AS (SELECT o_custkey AS k, o_orderpriority AS c, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS nd, avg(o_orderkey % 5) AS rating, avg(o_orderkey % 3 - 1) AS compound FROM orders GROUP BY 1, 2),
flags AS (SELECT o_custkey AS k, o_orderstatus AS s, max(o_orderkey % 2) AS flag FROM orders GROUP BY 1, 2)"""


_CARDS = f"""
WITH {_COUNTRIES}
SELECT 'play:' || c_custkey AS app_key, c_name AS title, coalesce(max(CASE WHEN s = 'F' THEN flag END), 0)::INTEGER AS ff, coalesce(max(CASE WHEN s = 'O' THEN flag END), 0)::INTEGER AS fo, coalesce(max(CASE WHEN s = 'P' THEN flag END), 0)::INTEGER AS fp,
  any_value(m.n)::BIGINT AS n_reviews, any_value(m.nd)::BIGINT AS n_nd, any_value(rating) AS avg_rating, any_value(i.pains)::BIGINT AS pains, any_value(i.praises)::BIGINT AS praises, any_value(i.aspects) AS top_aspects
FROM customer LEFT JOIN flags ON flags.k = c_custkey
LEFT JOIN (SELECT k, sum(n) AS n, sum(nd) AS nd, round(sum(rating * n) / sum(n), 6) AS rating FROM per GROUP BY 1) m ON m.k = c_custkey
LEFT JOIN (
  SELECT k, sum(pains) AS pains, sum(praises) AS praises, string_agg(s, '; ' ORDER BY n DESC, first) AS aspects FROM (
    SELECT o_custkey AS k, o_orderstatus AS s, count(*) AS n, min(o_orderkey) AS first, count(*) FILTER (o_orderpriority = '1-URGENT') AS pains, count(*) FILTER (o_orderpriority = '5-LOW') AS praises FROM orders GROUP BY 1, 2) GROUP BY 1) i ON i.k = c_custkey
GROUP BY c_custkey, c_name
"""


@query(_CARDS)
def app_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(_customers(spark, sf_dir), _flags(spark, sf_dir), _mood(spark, sf_dir), _labels(spark, sf_dir))


@query(_CARDS)
def bucketed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cards from tables that are written in buckets by app: nothing but scans, sorts within tasks and joins."""
    root, run = shared(spark), uuid.uuid4().hex
    sinks.without_exchange(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    made = {"customers": _customers, "flags": _flags, "mood": _mood, "labels": _labels}
    return _cards(*(sinks.bucketed(f(spark, sf_dir), f"tidemark_{name}_{run}", ["app_key"], n, f"{root}/cards-{run}/{name}") for name, f in made.items()))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "pain").when(F.col("o_orderpriority") == "5-LOW", "praise").otherwise("other")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("play:"), "o_custkey").alias("app_key"), kind.alias("type"), F.col("o_orderstatus").alias("aspects"), "o_orderkey")


def _cards(customers: DataFrame, flags: DataFrame, mood: DataFrame, labels: DataFrame) -> DataFrame:
    got = market.cards(customers, flags, mood, market.review_insights(labels, "o_orderkey"), ["ff", "fo", "fp"])
    return got.select("app_key", "title", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ff", "fo", "fp")), "n_reviews", "n_nd", F.round("avg_rating", 6).alias("avg_rating"), "pains", "praises", "top_aspects")


@query(f"""
WITH {_COUNTRIES}
SELECT 'play:' || flags.k AS app_key, 'f' || lower(s) AS feature, flag::INTEGER AS flag, c_name AS title, n_reviews, mean_compound
FROM flags LEFT JOIN customer ON c_custkey = flags.k
LEFT JOIN (SELECT k, round(avg(n), 6) AS n_reviews, round(avg(compound), 6) AS mean_compound FROM per GROUP BY 1) m ON m.k = flags.k
""")
def feature_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = market.bundle(_flags(spark, sf_dir), _customers(spark, sf_dir), _mood(spark, sf_dir))
    return got.select("app_key", "feature", "flag", "title", F.round("n_reviews", 6).alias("n_reviews"), F.round("mean_compound", 6).alias("mean_compound"))


def _page(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*(x for name, value in pairs for x in (F.lit(f"<div>{name}</div><div>"), value.cast("string"), F.lit("</div>\n"))))


def _k() -> Column:
    return F.col("s_suppkey")


_KEY32 = "translate(lpad(s_suppkey::VARCHAR, 32, '0'), '0123456789', 'abcdefghij')"


def _play_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(
        F.lit('<html><meta property="og:image" content="https://img.example/'), _k(), F.lit('.png"><title>'), F.col("s_name"), F.lit(" &amp; Co</title><script>4.9 out of 5</script><p>A fine <b>app</b>.</p><svg><p>no</p></svg><h2>Details</h2>"),
        _page(("Offered By", F.concat(F.lit("Maker "), _k(), F.lit(", 5 High Road"))), ("Category", F.lit("Tools")), ("Downloads", F.concat(_k(), F.lit("K+"))), ("Updated on", F.lit("Sep 12, 2025")), ("Version", F.concat(F.lit("1."), _k()))),
        F.lit("<p>"), (_k() % 5).cast("string"), F.lit(".5 out of 5</p><p>"), F.format_number(_k() * 100, 0), F.lit(' reviews</p><p>$1.99 - $20.00 per item</p><a href="https://play.google.com/x">s</a>'),
        F.when(_k() % 2 == 0, F.concat(F.lit('<a href="https://site'), _k(), F.lit('.example/">Visit website</a>'))).otherwise('<a href="https://other.example/a">x</a>'), F.lit("</html>"),
    )
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("com.a"), _k()).alias("id"), F.lit("https://store/").alias("url"), body.alias("html"))


@query("""
SELECT 'play:com.a' || s_suppkey AS app_key, s_name || ' & Co' AS title, 'Maker ' || s_suppkey AS developer, 'Tools' AS category, (s_suppkey % 5) + 0.5::DOUBLE AS rating_avg, (s_suppkey * 100)::BIGINT AS rating_count,
  (s_suppkey * 1000)::BIGINT AS installs_or_users, 1.99::DOUBLE AS iap_min, 20.0::DOUBLE AS iap_max, 2::BIGINT AS iap_count, CASE WHEN s_suppkey % 2 = 0 THEN 'https://site' || s_suppkey || '.example/' ELSE 'https://other.example/a' END AS website_url,
  '2025-09-12' AS last_update, '1.' || s_suppkey AS version, s_name || ' & Co' || chr(10) || 'A fine ' || chr(10) || 'app' || chr(10) || '.' AS description, 'https://img.example/' || s_suppkey || '.png' AS icon_url
FROM supplier
""")
def play_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stores.play_records(_play_pages(spark, sf_dir), "id", "url", "html")
    return got.select("app_key", "title", "developer", "category", "rating_avg", "rating_count", "installs_or_users", "iap_min", "iap_max", "iap_count", "website_url", "last_update", "version", "description", "icon_url")


def _key32() -> Column:
    return F.translate(F.lpad(_k().cast("string"), 32, "0"), "0123456789", "abcdefghij")


@query(f"""
SELECT 'cws:' || {_KEY32} AS app_key, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Page ' || s_suppkey END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Author' ELSE 'Shown' END AS developer,
  CASE WHEN s_suppkey % 2 = 0 THEN 4.5 ELSE 3.5 END::DOUBLE AS rating_avg, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 1200 END::BIGINT AS rating_count, (s_suppkey * 1000)::BIGINT AS installs_or_users,
  CASE WHEN s_suppkey % 2 = 0 THEN 'About it' ELSE NULL END AS described, '2025-09-17' AS last_update, CASE WHEN s_suppkey % 2 = 0 THEN '2.' || s_suppkey ELSE '9' END AS version
FROM supplier
""")
def cws_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page has linked data; the others show the same facts in their text."""
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.col("s_name").alias("name"), F.lit("About it").alias("description"), F.struct(F.lit("Author").alias("name")).alias("author"), F.concat(F.lit("2."), _k()).alias("softwareVersion"), F.struct(F.lit("4.5").alias("ratingValue"), _k().alias("ratingCount")).alias("aggregateRating"))), F.lit("</script>"))
    body = F.concat(F.lit("<title>Page "), _k(), F.lit("</title>"), F.when(_k() % 2 == 0, ld).otherwise(""), F.lit("<p>3.5 out of 5</p><p>1.2K ratings</p><p>"), F.format_number(_k() * 1000, 0), F.lit(" users</p>"), _page(("Offered by", F.lit("Shown")), ("Version", F.lit("9")), ("Updated", F.lit("September 17, 2025"))))
    got = stores.cws_records(table(spark, sf_dir, "supplier").select(_key32().alias("id"), F.lit("u").alias("url"), body.alias("html"), "s_suppkey"), "id", "url", "html")
    described = F.when(F.col("description") == "About it", F.col("description")).alias("described")
    return got.select("app_key", "title", "developer", "rating_avg", "rating_count", "installs_or_users", described, "last_update", "version")


@query("""
SELECT 'ios:' || s_suppkey AS app_key, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Seller' ELSE 'Artist' END AS developer, 4.25::DOUBLE AS rating_avg, s_suppkey::BIGINT AS rating_count,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Free' ELSE '$' || (s_suppkey % 3) || '.00' END AS pricing_raw, '2024-02-03' AS release_date, NULL::VARCHAR AS last_update, '3.1' AS version
FROM supplier
""")
def ios_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(_k().alias("trackId"), F.col("s_name").alias("trackName"), F.when(_k() % 2 == 0, "Seller").alias("sellerName"), F.lit("Artist").alias("artistName"), F.lit(4.25).alias("averageUserRating"), _k().alias("userRatingCount"), (_k() % 3).cast("double").alias("price"), F.lit("2024-02-03T23:59:59Z").alias("releaseDate"), F.lit("soon").alias("currentVersionReleaseDate"), F.lit("3.1").alias("version"))
    got = stores.ios_records(table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(one).alias("results"))).alias("body")), "body")
    return got.select("app_key", "title", "developer", "rating_avg", "rating_count", "pricing_raw", "release_date", "last_update", "version")


@query("""
SELECT 'ios:' || s_suppkey AS app_key, 'r' || s_suppkey || '-' || n AS review_id, CASE n WHEN 1 THEN 5 ELSE 0 END AS rating, CASE n WHEN 1 THEN 'T' ELSE '' END AS title, 'said ' || n AS body, CASE n WHEN 1 THEN TIMESTAMP '2024-01-02 03:04:05' END AS at
FROM supplier, (VALUES (1), (2)) AS v(n) WHERE n = 1 OR s_suppkey % 2 = 0 UNION ALL
SELECT 'play:com.a' || s_suppkey, 'p' || s_suppkey, (s_suppkey % 5)::INTEGER, NULL, 'body', TIMESTAMP '2024-05-06 07:08:09' FROM supplier
""")
def store_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of both stores. A feed begins with the app itself."""
    rows = table(spark, sf_dir, "supplier")
    label = lambda c: F.struct(c.alias("label"))
    entry = lambda n, *more: F.to_json(F.struct(label(F.concat(F.lit("r"), _k(), F.lit(f"-{n}"))).alias("id"), F.struct(F.struct(F.lit("x").alias("type"), F.lit(f"said {n}").alias("label")).alias("content")).getField("content").alias("content"), *more))
    first = entry(1, label(F.lit("5")).alias("im:rating"), label(F.lit("T")).alias("title"), label(F.lit("2024-01-02T03:04:05Z")).alias("updated"))
    feed = F.concat(F.lit('{"feed": {"entry": [{"id": {"label": "app"}}, '), first, F.when(_k() % 2 == 0, F.concat(F.lit(", "), entry(2))).otherwise(""), F.lit("]}}"))
    ios = stores.ios_reviews(rows.select(_k().cast("string").alias("a"), F.lit("us").alias("c"), feed.alias("b")), "a", "c", "b")
    page = F.to_json(F.array(F.struct(F.concat(F.lit("p"), _k()).alias("reviewId"), F.lit("body").alias("content"), (_k() % 5).cast("int").alias("score"), F.lit("2024-05-06T07:08:09Z").alias("at"))))
    play = stores.play_reviews(rows.select(F.concat(F.lit("com.a"), _k()).alias("a"), F.lit("us").alias("c"), page.alias("b")), "a", "c", "b")
    cols = ("app_key", "review_id", "rating", "title", "body", "at")
    return ios.select(*cols).unionByName(play.select(*cols)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"""
SELECT DISTINCT 'PlayStore' AS store, 'com.k' || (s_suppkey % 40) AS id FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM (SELECT min(s_suppkey) AS s_suppkey, s_nationkey FROM supplier GROUP BY s_nationkey, s_suppkey % 40)) WHERE r <= 2 UNION ALL
SELECT 'ChromeWS', {_KEY32} FROM supplier UNION ALL SELECT 'AppStore', s_suppkey::VARCHAR FROM supplier
""")
def discovered_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that search pages and payloads lead to; two at most for each keyword of the first store."""
    rows = table(spark, sf_dir, "supplier")
    links = F.array_join(F.transform(F.array_sort(F.collect_list(_k())), lambda k: F.concat(F.lit('<a class="x" href="/store/apps/details?id=com.k'), k % 40, F.lit('&hl=en">a</a>'))), "\n")
    pages = rows.groupBy("s_nationkey", F.floor(_k() / 500).alias("page")).agg(links.alias("html"))  # of five hundred links at most
    play = stores.discovered(pages, "play", "s_nationkey", "html", 2, "page")
    cws = stores.discovered(rows.select("s_nationkey", F.concat(F.lit("<a href='https://x/detail/name/"), _key32(), F.lit("?q'>b</a><a href='/none'>c</a>")).alias("html")), "cws", "s_nationkey", "html")
    ios = stores.discovered_ios(rows.select(F.concat(F.lit('{"results": [{"trackId": '), _k(), F.lit('}, {"other": 1}]}')).alias("b")), "b")
    return play.unionByName(cws).unionByName(ios)


@query("""
SELECT 'com.a' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'no id' WHEN s_suppkey % 10 = 1 THEN 'unknown store' WHEN s_suppkey % 10 = 2 THEN 'no page' WHEN s_suppkey % 10 = 3 THEN 'no title' ELSE 'record' END AS outcome
FROM supplier WHERE s_suppkey % 10 > 0 UNION ALL SELECT NULL, 'no id' FROM supplier WHERE s_suppkey % 10 = 0
""")
def record_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the record they get, or the reason why they get none."""
    k = _k() % 10
    wanted = table(spark, sf_dir, "supplier").select(F.when(k == 1, "Other").otherwise("PlayStore").alias("store"), F.when(k > 0, F.concat(F.lit("com.a"), _k())).alias("id"))
    pages = _play_pages(spark, sf_dir).where(~F.col("id").rlike("2$")).withColumn("html", F.when(F.col("id").rlike("3$"), "<p>gone</p>").otherwise(F.col("html")))
    got, failed = stores.records(wanted, {"PlayStore": stores.play_records(pages, "id", "url", "html")})
    return got.select("id", F.lit("record").alias("outcome")).unionByName(failed.select("id", F.col("failure").alias("outcome")))


@query("""
SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0)::BIGINT AS timer, count(*) FILTER (o_orderkey % 3 = 1)::BIGINT AS adhd_support, 0::BIGINT AS rewards FROM orders GROUP BY 1
""")
def matching_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _case(F.col("o_orderkey") % 3, "count down, countdown", "add it", None)
    return tagging.matching_counts(table(spark, sf_dir, "orders"), ["o_custkey"], said, {n: tagging.DOMAIN[n] for n in ("timer", "adhd_support", "rewards")})


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'row' WHEN p_size % 4 = 1 THEN 'ios:' || p_partkey ELSE 'play:x' || p_partkey END AS app_key, CASE WHEN p_size % 4 = 1 THEN 'AppStore' WHEN p_size % 4 > 1 THEN 'PlayStore' END AS store,
  CASE WHEN p_size % 4 = 1 THEN p_partkey::VARCHAR WHEN p_size % 4 > 1 THEN 'x' || p_partkey END AS id
FROM part
""")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of records with and without an id, and what they are split into."""
    k = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 1, " iOS ").otherwise("android").alias("s"), F.when(k == 1, F.concat(F.lit("id"), "p_partkey")).when(k > 1, F.concat(F.lit(" x"), "p_partkey")).alias("i"))
    rows = rows.withColumn("app_key", text.keyed_or_numbered(F.col("s"), F.col("i"), F.col("p_partkey")))
    store, own = text.split_key(F.col("app_key"))
    numbered = F.col("app_key") == F.concat(F.lit("row:"), "p_partkey")
    return rows.select("p_partkey", F.when(numbered, "row").otherwise(F.col("app_key")).alias("app_key"), store.alias("store"), F.when(~numbered, own).alias("id"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1234567 WHEN 1 THEN 8400 ELSE NULL END::BIGINT AS compact, CASE p_partkey % 3 WHEN 0 THEN DATE '2024-05-06' WHEN 1 THEN DATE '2024-05-06' END AS iso, CASE p_partkey % 3 WHEN 0 THEN '2024-05-06T00:00:00Z' WHEN 1 THEN '2024-05-06T07:08:09Z' END AS shown,
  CASE p_partkey % 3 WHEN 0 THEN 'Focus Mode' WHEN 1 THEN 'A' ELSE '' END AS label
FROM part
""")
def small_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dates

    k = F.col("p_partkey") % 3
    day = _case(k, "2024-05-06", "2024-05-06T07:08:09Z", "May 6, 2024")
    return table(spark, sf_dir, "part").select(
        "p_partkey", numbers.compact(_case(k, "about 1,234,567", "8.4K", "none")).alias("compact"), dates.iso_only(day).alias("iso"), dates.iso_z(dates.instant(day)).alias("shown"), text.title_case(_case(k, "focus_mode", "a", "")).alias("label"),
    )
