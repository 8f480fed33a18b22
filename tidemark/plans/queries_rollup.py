"""Queries for dedupe, joins, roll-ups, rankings, agreement, dashboards and the feed."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import aggregate, dedupe, done_keys, flatten, gates, joins, numbering, schema, sentiment
from ..sources import paged, stores
from ..streaming import feed, live
from .base import query, shared, table
from .queries_text import norm_sql


@query("""
SELECT o_custkey, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END DESC NULLS FIRST, o_totalprice DESC NULLS FIRST, o_orderkey) AS r FROM orders)
WHERE r = 1
""")
def keep_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate")))
    return dedupe.keep_latest(rows, ["o_custkey"], "o_orderdate", "o_totalprice", [F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def keep_first_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_distinct(table(spark, sf_dir, "documents"), ["text"], ["lang"], "doc_id")


@query("SELECT conv_id, role, arg_max(turn, turn) AS turn FROM conversations GROUP BY conv_id, role")
def keep_last_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_last(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.col("turn").desc()]).select("conv_id", "role", "turn")


@query("SELECT user_id, event_id, r::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def head_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedupe.top_rows(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()], 5, "position")
    return got.select("user_id", "event_id", "position")


_FORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
SELECT min(k) AS kept, count(*)::BIGINT AS n FROM (
  SELECT doc_id % 3 AS app_key, first_value(doc_id) OVER (PARTITION BY doc_id % 3, {_FORM} ORDER BY CASE WHEN doc_id % 5 > 0 THEN n_chars + doc_id END DESC NULLS LAST,
    CASE WHEN doc_id % 5 = 0 THEN length(text) END DESC NULLS LAST, doc_id) AS k, {_FORM} AS f FROM documents)
GROUP BY app_key, f
""")
def best_text_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 3).alias("app_key"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") + F.col("doc_id")).alias("at"))
    return dedupe.best_per_text(rows, "app_key", "text", "at", "doc_id", ["doc_id"]).select(F.col("doc_id").alias("kept"), "n")


@query("""
SELECT role, count(*)::BIGINT AS n_reviews, count(*) FILTER (turn = 0)::BIGINT AS n_nd, round(avg(turn % 5), 6) AS avg_rating, round(avg(score), 4) AS mean_compound,
  round(avg((score >= 0.05)::INT), 6) AS pct_positive, round(avg((score <= -0.05)::INT), 6) AS pct_negative
FROM (SELECT role, turn, round(s / sqrt(s * s + 15), 4) AS score FROM (
  SELECT conv_id, role, turn, list_sum(list_transform(string_split(n, ' '), lambda w: CASE w WHEN 'the' THEN 1.5 WHEN 'of' THEN -0.5 WHEN 'in' THEN 0.25 WHEN 'und' THEN -1.0 ELSE 0.0 END::DOUBLE)) AS s
  FROM (SELECT *, NORM AS n FROM conversations)))
GROUP BY role
""".replace("NORM", norm_sql("text").replace("_]+", "'']+").replace("\\p{N}'']+", "\\p{N}'']+")))
def sentiment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = {"the": 1.5, "of": -0.5, "in": 0.25, "und": -1.0}
    rows = table(spark, sf_dir, "conversations").select("role", "turn", sentiment.lexicon_score(F.col("text"), lexicon).alias("sentiment_score"))
    rows = rows.withColumns({"sentiment_label": numbers.polarity(F.col("sentiment_score")), "special_reviews": F.col("turn") == 0, "rating": F.col("turn") % 5})
    got = aggregate.sentiment_by_app(rows, ["role"])
    return got.select("role", "n_reviews", "n_nd", *(F.round(c, 4 if c == "mean_compound" else 6).alias(c) for c in ("avg_rating", "mean_compound", "pct_positive", "pct_negative")))


@query("""
SELECT user_id, sum(w)::BIGINT AS n_reviews, round(CASE WHEN sum(w) <= 0 THEN avg(v) ELSE sum(v * w) / sum(w) END, 6) AS score
FROM (SELECT user_id, event_type, count(*) FILTER (value > 20) AS w, coalesce(avg(value) FILTER (value < 200), 0) AS v FROM events GROUP BY 1, 2) GROUP BY user_id
""")
def weighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 20).alias("n_reviews"), F.avg(F.when(F.col("value") < 200, F.col("value"))).alias("score"))
    return aggregate.weighted_rollup(per, ["user_id"], "n_reviews", ["score"], ["n_reviews"]).select("user_id", "n_reviews", F.round("score", 6).alias("score"))


@query("SELECT user_id, round(avg(n), 6) AS n, round(avg(v), 6) AS v FROM (SELECT user_id, event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY user_id")
def unweighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return aggregate.plain_rollup(per, ["user_id"], ["n", "v"]).select("user_id", F.round("n", 6).alias("n"), F.round("v", 6).alias("v"))


@query("""
SELECT c_custkey, c_name, n_name, coalesce(f, 0)::INTEGER AS "F", coalesce(o, 0)::INTEGER AS "O", coalesce(p, 0)::INTEGER AS "P", mean_price
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS f, max((o_orderstatus = 'O')::INT) AS o, max((o_orderstatus = 'P')::INT) AS p,
  ((20000 * sum(round(o_totalprice * 100)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 1000000 AS mean_price FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def card_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice").withColumn("flag", F.lit(1))
    flags = aggregate.matrix(orders, "c_custkey", "o_orderstatus", "flag", "max", ["F", "O", "P"])
    # prices are whole cents: their means are exact to six decimals
    means = aggregate.plain_rollup(orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), ["c_custkey"], ["o_totalprice"]).withColumnRenamed("o_totalprice", "mean_price")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = joins.enriched(joins.enriched(joins.one_to_one(customers, nations, ["c_nationkey"], [F.col("n_name").asc()]), flags, ["c_custkey"], "_f"), means, ["c_custkey"], "_m")
    return out.select("c_custkey", "c_name", "n_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("F", "O", "P")), F.col("mean_price").cast("double").alias("mean_price"))


@query("""
SELECT l_orderkey, l_linenumber, o_orderstatus, o_comment_left FROM (
  SELECT l_orderkey, l_linenumber, o_orderstatus, l_returnflag AS o_comment_left FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)
""")
def bundle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.col("l_returnflag").alias("status"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    got = joins.one_to_one(left, right, ["key"], [F.col("status").asc()], "_apps")
    return got.select(F.col("key").alias("l_orderkey"), "l_linenumber", F.col("status_apps").alias("o_orderstatus"), F.col("status").alias("o_comment_left"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
SELECT doc_id AS id, 'old' AS origin FROM labels UNION ALL
SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("old").alias("origin"))
    return joins.appended(old, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("new").alias("origin")), ["id"])


@query("""
WITH e AS (SELECT user_id, event_type, event_id, unnest([event_type, 'k' || ((props::JSON->>'k')::INT % 9)]) AS item, unnest([0, 1]) AS p FROM events),
c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1),
f AS (SELECT user_id, item, count(*) AS n, min(event_id * 2 + p) AS first FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM f)
SELECT user_id, c.n::BIGINT AS n, clicks::BIGINT AS clicks, views::BIGINT AS views, string_agg(item, '; ' ORDER BY r) AS top_aspects
FROM c JOIN r USING (user_id) WHERE r <= 8 GROUP BY ALL
""")
def label_counts_top_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("aspects", F.concat_ws(";", "event_type", F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 9).cast("string"))))
    counts = aggregate.class_counts(rows, ["user_id"], "event_type", {"clicks": "click", "views": "view"})
    return counts.join(aggregate.top_items(rows, ["user_id"], text.listed(F.col("aspects"), ";"), ["event_id"], 8, "top_aspects"), "user_id")


@query("SELECT p_brand, p_type, count(DISTINCT p_size)::BIGINT AS features, round(avg(p_size % 3 - 1), 6) AS mean_support, round(avg((p_retailprice > 1200)::INT), 6) AS share_nd_specific FROM part GROUP BY 1, 2")
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("undermining"), F.lit("neutral"), F.lit("supportive")), F.col("p_size") % 3 + 1)
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_size").alias("feature_name"), numbers.support_value(label).alias("support_val"), (F.col("p_retailprice") > 1200).alias("nd_specific"))
    got = aggregate.taxonomy_rollup(rows, ["p_brand", "p_type"])
    return got.select("p_brand", "p_type", "features", F.round("mean_support", 6).alias("mean_support"), F.round("share_nd_specific", 6).alias("share_nd_specific"))


@query("""
WITH w AS (SELECT doc_id, quality AS q, toxic AS t, (n_chars > 1500)::INT AS c FROM labels JOIN documents USING (doc_id)),
p AS (SELECT 'long' AS rater_a, 'quality' AS rater_b, c AS a, q AS b FROM w UNION ALL SELECT 'long', 'toxic', c, t FROM w UNION ALL SELECT 'quality', 'toxic', q, t FROM w)
SELECT rater_a, rater_b, round((po - pe) / (1 - pe), 3) AS kappa, n FROM (
  SELECT rater_a, rater_b, count(*)::BIGINT AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM p GROUP BY 1, 2)
""")
def rater_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    long = rows.select("doc_id", F.col("quality"), F.col("toxic"), (F.col("n_chars") > 1500).cast("int").alias("long")).unpivot(["doc_id"], ["quality", "toxic", "long"], "model", "present")
    return aggregate.rater_agreement(long, ["doc_id"], "model", "present")


@query("""
WITH m AS (SELECT conv_id // 20 AS item, 'r' || ((conv_id * 7 + turn) % 500) AS rater, max((length(text) % 3 > 0)::INT) AS v FROM conversations GROUP BY 1, 2),
t AS (SELECT count(DISTINCT item) AS n FROM m), o AS (SELECT rater, sum(v) AS k FROM m GROUP BY rater),
c AS (SELECT x.rater AS a, y.rater AS b, count(*) AS nb FROM m x JOIN m y ON x.item = y.item AND x.rater < y.rater WHERE x.v = 1 AND y.v = 1 GROUP BY 1, 2),
p AS (
  SELECT x.rater AS rater_a, y.rater AS rater_b, n, 1 - (x.k + y.k - 2 * coalesce(nb, 0)) / n::DOUBLE AS po, (x.k / n::DOUBLE) * (y.k / n::DOUBLE) + (1 - x.k / n::DOUBLE) * (1 - y.k / n::DOUBLE) AS pe
  FROM o x JOIN o y ON x.rater < y.rater CROSS JOIN t LEFT JOIN c ON c.a = x.rater AND c.b = y.rater)
SELECT rater_a, rater_b, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 3) END AS kappa, n::BIGINT AS n FROM p
""")
def many_raters_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred raters of stretches of twenty conversations."""
    shared(spark)
    v = (F.length("text") % 3 > 0).cast("int")
    rows = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 20).alias("item"), F.concat(F.lit("r"), (F.col("conv_id") * 7 + F.col("turn")) % 500).alias("rater"), v.alias("v"))
    return aggregate.rater_agreement(rows, ["item"], "rater", "v")


@query("""
SELECT item, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '["\\\\\\x00-\\x1f]', '', 'g')), ','), lambda x: trim(x) <> '')) AS raw, trim(raw) AS item FROM documents)
GROUP BY item ORDER BY n DESC, item LIMIT 10
""")
def list_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lists of what is between commas, apostrophes and brackets inside; every fiftieth is written with escaped
    apostrophes in single quotes, the others in double quotes."""
    plain = F.regexp_replace("text", r'["\\\x00-\x1f]', "")
    double = F.concat(F.lit('["'), F.regexp_replace(plain, ",", '", "'), F.lit('"]'))
    single = F.concat(F.lit("['"), F.regexp_replace(F.replace(plain, F.lit("'"), F.lit("\\'")), ",", "', '"), F.lit("']"))
    docs = table(spark, sf_dir, "documents").select(text.literal_list(F.when(F.col("doc_id") % 50 == 0, single).otherwise(double)).alias("items"))
    return aggregate.frequencies(docs, F.col("items")).orderBy(F.desc("n"), "item").limit(10)


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n FROM documents ORDER BY n DESC, doc_id LIMIT 10")
def list_size_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n")).orderBy(F.desc("n"), "doc_id").limit(10)


@query("""
SELECT place, CASE WHEN r <= 5 THEN 'head' ELSE 'tail' END AS half, p_brand, n FROM (
  SELECT 'Ranked #' || row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r, p_brand, count(*)::BIGINT AS n FROM part GROUP BY p_brand)
WHERE r <= 10
""")
def ranked_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    top = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)
    ranked = top.withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "p_brand")))  # ten rows
    return ranked.select(F.concat(F.lit("Ranked #"), F.col("r").cast("string")).alias("place"), F.when(F.col("r") <= 5, "head").otherwise("tail").alias("half"), "p_brand", "n")


@query("SELECT count(*)::BIGINT AS apps, round(avg(p_retailprice), 4) AS mean_price, count(DISTINCT p_brand)::BIGINT AS brands, arg_max(p_name, (p_retailprice, -p_partkey)) AS dearest, sum(p_size)::BIGINT AS installs FROM part")
def kpi_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(
        F.count(F.lit(1)).alias("apps"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"), F.countDistinct("p_brand").alias("brands"),
        F.max_by("p_name", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.sum(numbers.first_digits(F.col("p_size"))).alias("installs"),
    )


@query("SELECT p_partkey, p_name, p_size FROM part WHERE regexp_matches(p_name, '(?i)A|E') AND p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_size DESC, p_partkey LIMIT 50")
def facet_search_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    brand = rows.agg(F.min("p_brand")).first()[0]
    got = gates.faceted(gates.searched(rows, "p_name", "A|E"), {"p_type": "All", "p_brand": brand})
    return got.orderBy(F.desc("p_size"), "p_partkey").limit(50).select("p_partkey", "p_name", "p_size")


@query("SELECT DISTINCT c_mktsegment AS facet FROM customer")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("facet")).distinct().orderBy("facet")


@query("SELECT event_type, round(avg(value), 6) AS mean_value, count(*)::BIGINT AS n FROM events GROUP BY 1")
def class_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def two_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT bin, count(*)::BIGINT AS n FROM (SELECT CASE WHEN s > -1 AND s <= -0.05 THEN 'Negative' WHEN s > -0.05 AND s <= 0.05 THEN 'Neutral' WHEN s > 0.05 AND s <= 1 THEN 'Positive' END AS bin
  FROM (SELECT (l_linenumber - 4) * 20 / 100.0::DOUBLE * CASE WHEN l_linenumber = 1 THEN 5 / 3.0::DOUBLE ELSE 1 END AS s FROM lineitem)) WHERE bin IS NOT NULL GROUP BY bin
""")
def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("l_linenumber") - 4) * 20 / F.lit(100.0) * F.when(F.col("l_linenumber") == 1, F.lit(5) / F.lit(3.0)).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(numbers.score_bin(s).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (r <= 6) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id")
def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.joined_texts(table(spark, sf_dir, "conversations"), ["conv_id"], "text", "turn", " ", 6)


@query("SELECT s_suppkey, upper(s_name) || '' AS name, s_nationkey AS nation, NULL::DOUBLE AS score, 'PlayStore' AS store FROM supplier")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "supplier").withColumn("score", F.lit(None).cast("double"))
    names = {"s_suppkey": ("id", "s_suppkey"), "name": ("title", "s_name"), "nation": ("s_nationkey", "s_suppkey"), "score": ("score", "s_acctbal"), "store": ("store",)}
    return schema.resolved(raw, names, {"store": "PlayStore"}).withColumn("name", F.upper("name"))


@query("SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN 'Free' ELSE '$' || printf('%.2f', p_size / 4.0) END AS price, (p_size % 3 - 1)::INTEGER AS support FROM part")
def price_and_support_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("undermining"), F.lit("who knows"), F.lit("supportive")), F.col("p_size") % 3 + 1)
    price = numbers.price_label(F.when(F.col("p_retailprice") <= 1500, F.col("p_size") / 4))
    return table(spark, sf_dir, "part").select("p_partkey", price.alias("price"), numbers.support_value(label).alias("support"))


@query("""
SELECT event_id, feature_name, category, support, support_val, nd_specific, evidence FROM (
  SELECT event_id, substring(event_type || ' feature', 1, 100) AS feature_name, '' AS category, CASE WHEN event_id % 2 = 0 THEN 'supportive' ELSE 'neutral' END AS support,
    (event_id % 2 = 0)::INTEGER AS support_val, event_id % 5 = 0 AS nd_specific, '' AS evidence FROM events WHERE event_id % 3 > 0)
""")
def taxonomy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    made = F.concat(F.lit('{"features": [{"name": "'), F.col("event_type"), F.lit(' feature", "nd_specific": '), (k % 5 == 0).cast("string"), F.when(k % 2 == 0, ', "support": "supportive"').otherwise(""), F.lit("}]}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k % 3 > 0, made).otherwise("none").alias("a"))
    return flatten.taxonomy_rows(rows, "a", ["event_id"])


_FEED = "event_id long, user_id long, event_type string, value double, at string, seq long"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("event_id") % 11 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.when(F.col("event_id") % 2 == 0, "soon"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", at.alias("at"), F.col("event_id").alias("seq"))


@query("""
SELECT min(event_id) AS event_id, user_id, value FROM events GROUP BY user_id, value
""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed in batches: the first row of each (user, value), whichever batch it comes in."""
    root = f"{shared(spark)}/feed-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("app_key"), F.col("value").cast("string").alias("review_id"), F.col("event_id").cast("string").alias("body"), F.lit(None).cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    step = ((high - low) // 4 + 1) if low is not None else 1
    for k in range(4):  # what comes in is a quarter of the table each time, and a batch
        rows.where(F.floor((F.col("seq") - (low or 0)) / step) == k).write.mode("append").parquet(f"{root}/in")
        stream = feed.feed(spark, f"{root}/in", "app_key string, review_id string, body string, at timestamp, seq long", files_per_batch=1_000_000)
        feed.finish(feed.start(stream, f"{root}/table", f"{root}/state", ["app_key"], "review_id", "seq"))
    got = feed.latest(spark, f"{root}/table", ["app_key"], "body", "at", "seq")
    return got.select(F.col("seq").alias("event_id"), F.col("app_key").cast("bigint").alias("user_id"), F.col("review_id").cast("double").alias("value"))


@query("""
SELECT 'play:' || (conv_id % 20) AS app_key, role AS country, conv_id || '-' || turn AS review_id, md5(text) AS body, (turn % 5 + 1)::INTEGER AS rating FROM conversations
""")
def paged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as reviews on saved pages, twenty apps in as many countries as there are roles, read page by page by the source,
    a partition for each (app, country)."""
    root = f"{shared(spark)}/pages-{uuid.uuid4().hex}"
    one = F.struct(F.concat_ws("-", "conv_id", "turn").alias("reviewId"), F.lit("u").alias("userName"), F.col("text").alias("content"), (F.col("turn") % 5 + 1).cast("int").alias("score"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).cast("string").alias("app"), F.col("role").alias("country"), F.floor(F.col("conv_id") / 500).alias("page"), one.alias("one"))
    pages = rows.groupBy("app", "country", "page").agg(F.to_json(F.collect_list("one")).alias("value"))  # of five conversations each
    pages.repartition("app", "country").sortWithinPartitions("app", "country", "page").select("app", "country", "value").write.partitionBy("app", "country").text(f"{root}/saved")
    feeds = [tuple(r) for r in rows.select("app", "country").distinct().collect()]  # what to read is the caller's list
    got = paged.pages(spark, paged.Stored(f"{root}/saved"), feeds, name="saved_pages", pages=1_000_000)
    reviews = stores.play_reviews(got.where("error is null"), "app_id", "country", "body")
    return reviews.select("app_key", "country", "review_id", F.md5("body").alias("body"), "rating")


@query("""
SELECT k, source, row_number() OVER (ORDER BY source, seq) - 1 AS n FROM (
  SELECT k, min(source) AS source, min(seq) FILTER (source = least_source) AS seq FROM (
    SELECT *, min(source) OVER (PARTITION BY k) AS least_source FROM (
      SELECT md5(text) AS k, 0 AS source, conv_id * 1000000 + turn AS seq FROM conversations UNION ALL SELECT md5(text), 1, doc_id FROM documents))
  GROUP BY k)
""")
def first_sight_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of conversations and then of documents, numbered in the order of first sight."""
    shared(spark)
    key = F.md5(F.encode("text", "UTF-8")).alias("k")
    talks = table(spark, sf_dir, "conversations").select(key, (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("at"))
    docs = table(spark, sf_dir, "documents").select(key, F.col("doc_id").alias("at"))
    return numbering.numbered(numbering.first_sights([(talks, ["at"]), (docs, ["at"])], ["k"]), ["source", "seq"]).select("k", "source", "n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no label yet, by the stored filter of those that have."""
    root = f"{shared(spark)}/done-{uuid.uuid4().hex}"
    done = table(spark, sf_dir, "labels").select("doc_id")
    done_keys.filter_of(done, ["doc_id"]).write.parquet(f"{root}/filter")
    known = spark.read.schema(done_keys.SCHEMA).parquet(f"{root}/filter")
    return done_keys.not_done(table(spark, sf_dir, "documents").select("doc_id"), done, ["doc_id"], known)


_AT = "CASE WHEN conv_id % 5 > 0 THEN (conv_id * 37 + turn) % 1000 END"


@query(f"""
WITH named AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) = 1)
SELECT conv_id, role, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY role, {_FORM} ORDER BY {_AT} DESC NULLS LAST, CASE WHEN conv_id % 5 = 0 THEN length(text) END DESC NULLS LAST, conv_id, turn) AS r FROM named)
WHERE r = 1
""")
def live_best_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as reviews that come in two waves, the feed being stopped and started again between them: of each (role,
    conversation) the first message, and of these the best of each text, as the live table stands in the end."""
    root = f"{shared(spark)}/live-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.when(F.col("conv_id") % 5 > 0, F.timestamp_seconds((F.col("conv_id") * 37 + F.col("turn")) % 1000)))
    rows = rows.withColumn("seq", F.col("conv_id") * 1_000_000 + F.col("turn"))
    half = rows.agg(F.min("conv_id"), F.max("conv_id")).first()
    first_wave = F.coalesce(F.col("conv_id") < F.lit(sum(half) // 2 if half[0] is not None else 0), F.lit(False))
    for wave in (first_wave, ~first_wave):
        rows.where(wave).write.mode("append").parquet(f"{root}/in")
        stream = feed.feed(spark, f"{root}/in", rows.schema, files_per_batch=1_000_000)  # a wave is a batch
        changes = live.standing_changes(stream, "role", "conv_id", "text", "at", "seq")
        live.start(changes, f"{root}/table", f"{root}/state", many=False).awaitTermination()
    return live.standing(spark, f"{root}/table", changes.schema).select("conv_id", "role", "turn")


@query("""
SELECT event_id, user_id FROM events WHERE (event_id % 11 > 0 AND ts >= TIMESTAMP '2024-01-21 00:00:00') OR (event_id % 11 = 0 AND event_id % 2 = 0)
""")
def stream_late_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed without late rows; rows without a time go, rows whose time can't be read stay."""
    root = f"{shared(spark)}/feed-{uuid.uuid4().hex}"
    _batches(spark, sf_dir).write.parquet(f"{root}/in")
    late = feed.not_late(feed.feed(spark, f"{root}/in", _FEED), "at", dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc), 10)
    feed.start_append(late, f"{root}/table", f"{root}/state").awaitTermination()
    return spark.read.schema(_FEED).parquet(f"{root}/table").select("event_id", "user_id")
