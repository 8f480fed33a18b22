"""The market pipeline as plans: raw records to a clean catalog, reviews to signals, signals to matrices and cards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import aggregate, dedupe, gates, joins, numbering, schema, scoring, sentiment, tagging
from ..sources import readers
from .base import shared

#: Target columns and the names under which sources have them, in order (fixed values).
ALIASES = {
    "store": ("store",),
    "id": ("id", "app_id", "package"),
    "app_key": ("app_key",),
    "title": ("title", "name"),
    "developer": ("developer", "offered_by", "seller"),
    "category": ("genre", "category"),
    "rating_avg": ("rating_avg", "ratingValue", "score"),
    "rating_count": ("rating_count", "ratingCount", "ratings"),
    "store_url": ("store_url",),
    "icon_url": ("icon_url",),
    "version": ("version",),
    "pricing_raw": ("pricing_raw",),
    "iap_min": ("iap_min",),
    "iap_max": ("iap_max",),
    "installs_or_users": ("installs_or_users", "installs", "users"),
    "release_date": ("release_date", "released", "releaseDate"),
    "last_update": ("last_update", "updated", "lastUpdated"),
    "scraped_at": ("scraped_at", "scrapedAt"),
}
#: Columns for which an alias without any value is passed over (fixed values).
FILLED_ALIASES = {"description": ("description", "description_full", "summary"), "website_url": ("website_url", "website", "url")}
CATALOG = ("app_key", "store", "id", "app_id", "title", "developer", "category", "installs_or_users", "rating_avg", "rating_count", "iap_min", "iap_max", "pricing_raw", "description",
           "website_url", "store_url", "icon_url", "version", "release_date", "last_update", "relevance_score", "scraped_at")


def normalized(raw: DataFrame, as_of: dt.date, weights: scoring.Weights | None = None) -> DataFrame:
    """A raw dump of mixed records as the typed catalog, in one projection."""
    picked = {t: schema.existing(raw, names, "PlayStore" if t == "store" else None) for t, names in ALIASES.items()}
    picked |= {t: schema.filled(raw, names) for t, names in FILLED_ALIASES.items()}
    rows = raw.select(*(c.cast("string").alias(t) for t, c in picked.items()))
    low, high, _ = numbers.price_range(F.col("pricing_raw"))
    own_low, own_high = numbers.number(F.col("iap_min")), numbers.number(F.col("iap_max"))
    neither = own_low.isNull() & own_high.isNull()
    store = text.store_name(F.col("store"))
    rows = rows.withColumns({
        "app_key": F.coalesce(text.blank_to_null(F.col("app_key")), text.app_key(F.col("store"), F.col("id"))), "store": store,
        "rating_avg": numbers.number(F.col("rating_avg")), "rating_count": numbers.number(F.col("rating_count")).cast("bigint"),
        "iap_min": F.when(neither, low).otherwise(own_low), "iap_max": F.when(neither, high).otherwise(own_high),
        "installs_or_users": numbers.scaled(F.col("installs_or_users")), "app_id": text.app_slug(F.col("title"), store),
        **{c: dates.parsed_date(F.col(c)) for c in ("release_date", "last_update", "scraped_at")},
    })
    fields = {c: F.col(c) for c in ("title", "category", "description", "developer")}
    score = scoring.relevance(fields, F.col("store"), F.col("rating_count"), F.col("installs_or_users"), F.col("last_update"), as_of, weights)
    return rows.withColumn("relevance_score", score).select(*CATALOG)


def checked(catalog: DataFrame, least_ratings: float = 50, least_installs: float = 10_000, least_users: float = 1000, least_relevance: float = 0.2, nulls: str = "win") -> DataFrame:
    """The latest row of each app, with ``drop_reason`` (null for those that stay). Rows without an id get the numbers that they
    have among such rows in the order of all their columns, however they are dealt into partitions."""
    shared(catalog.sparkSession)  # for what is written between
    rows = schema.normal_cells(schema.normal_names(catalog))
    rows = rows.withColumn("app_key", F.coalesce("app_key", text.app_key(F.col("store"), F.col("id")))).checkpoint()  # it is read twice
    nameless = numbering.numbered(rows.where("app_key is null"), [c for c in rows.columns if c != "app_key"], "__n")
    nameless = nameless.withColumn("app_key", text.keyed_or_numbered(F.col("store"), F.col("id"), F.col("__n"))).drop("__n")
    rows = rows.where("app_key is not null").unionByName(nameless)
    latest = dedupe.keep_latest(rows, ["app_key"], "scraped_at", "rating_count", [F.col("title").asc()], nulls)
    return latest.withColumn("drop_reason", gates.reasons({
        "missing_title_and_description": gates.readable(F.col("title"), F.col("description")),
        "below_popularity_thresholds": gates.popular(F.col("store"), F.col("rating_count"), F.col("installs_or_users"), least_ratings, least_installs, least_users),
        "low_relevance": gates.relevant(F.col("relevance_score"), least_relevance),
    }))


def scored_reviews(reviews: DataFrame, engine: str = "lexicon", as_of: dt.datetime | None = None, days: int | None = None, least_words: int = 0, special_only: bool = False) -> DataFrame:
    rows = reviews.withColumn("text", text.without_urls(text.compose(F.col("title"), F.col("body"))))
    if days is not None:
        rows = rows.where(dates.since(F.col("at"), as_of, days))
    rows = rows.where(gates.long_enough(F.col("text"), least_words))
    if special_only:
        rows = rows.where(F.coalesce("special_reviews", F.lit(False)))
    return sentiment.with_sentiment(rows, "text", engine)


def features_long(apps: DataFrame, websites: DataFrame, reviews: DataFrame, least_conf: float = 0.60, least_hits: int = 5, features: dict | None = None) -> DataFrame:
    """Per app and feature: flag, confidence, signals, review_hits. One scan of the reviews for all features."""
    table = features or tagging.DOMAIN
    said = F.trim(F.concat_ws(" ", "body", "title"))
    hits = tagging.tag_counts(reviews, ["app_key"], said, table).select("app_key", "feature", F.col("hits").alias("review_hits"))
    wide = joins.one_to_one(apps, websites.select("app_key", "website_text"), ["app_key"], [F.col("website_text").asc_nulls_last()])
    fields = {"title": F.col("title"), "description": F.col("description"), "website": F.col("website_text"), "metadata": F.concat_ws(" ", "category", "developer")}
    got = tagging.feature_signals(wide, ["app_key"], fields, hits, table)
    return got.withColumn("flag", numbers.threshold_flag(F.col("confidence"), F.col("review_hits"), least_conf, least_hits))


def features_from_files(spark: SparkSession, paths: list[str], manifest: list[str], least_conf: float = 0.60, least_hits: int = 5) -> DataFrame:
    """The long table from one CSV per feature: keys in one spelling, flags computed where a file has none, the last file's
    row for a repeated key. Only features of the manifest are taken."""
    cols = "app_key string, title string, confidence string, signals string, review_hits string, flag string"
    rows = readers.named_files(spark, paths, cols, manifest=manifest).withColumn("__file", F.col("_metadata.file_name"))
    hits, conf = numbers.number_or(F.col("review_hits"), 0).cast("bigint"), numbers.number_or(F.col("confidence"), 0.0)
    flag = F.coalesce(numbers.number(F.col("flag")).cast("int"), numbers.threshold_flag(conf, hits, least_conf, least_hits))
    parts = F.split(F.regexp_replace("app_key", "::", ":"), ":", 2)
    key = text.app_key(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    long = rows.select(F.coalesce(key, F.col("app_key")).alias("app_key"), "feature", flag.alias("flag"), conf.alias("confidence"), hits.alias("review_hits"), "__file")
    return dedupe.keep_last(long, ["app_key", "feature"], [F.col("__file").desc(), F.col("confidence").desc()]).drop("__file")


def bundle(long: DataFrame, apps: DataFrame, app_sentiment: DataFrame) -> DataFrame:
    """The long table with metadata and with sentiment averaged over countries."""
    means = aggregate.plain_rollup(app_sentiment, ["app_key"], ["n_reviews", "n_nd", "avg_rating", "mean_compound", "pct_positive", "pct_negative"])
    with_apps = joins.one_to_one(long, apps, ["app_key"], [F.col("title").asc_nulls_last()], "_apps")
    return joins.enriched(with_apps, means, ["app_key"], "_sent")


def cards(apps: DataFrame, long: DataFrame, app_sentiment: DataFrame, insights: DataFrame, features: list[str]) -> DataFrame:
    """One row per app: metadata, feature flags, sentiment weighted over countries, review insights."""
    flags = aggregate.matrix(long, "app_key", "feature", "flag", "max", features)
    mood = aggregate.weighted_rollup(app_sentiment, ["app_key", "store"], "n_reviews", ["avg_rating", "mean_compound", "pct_positive", "pct_negative"], ["n_reviews", "n_nd"])
    out = joins.enriched(apps, flags, ["app_key"], "_flag")
    out = joins.on_shared(out, mood, ["app_key", "store"], "app_key", "_sent")
    return joins.enriched(out, insights, ["app_key"], "_insight")


def review_insights(labels: DataFrame, seq: str) -> DataFrame:
    """Per app: labelled reviews, pains, praises, unmet needs, and the most frequent aspects."""
    counts = aggregate.class_counts(labels, ["app_key"], "type", {"pains": "pain", "praises": "praise", "unmet": "unmet"}).withColumnRenamed("n", "n_reviews_labeled")
    aspects = aggregate.top_items(labels, ["app_key"], text.listed(F.col("aspects"), ";"), [seq], 8, "top_aspects")
    return counts.join(aspects, "app_key", "left")
