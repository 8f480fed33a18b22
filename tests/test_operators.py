"""Operators on small tables: nulls, ties, repeated rows, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate, dedupe, enrich, flatten, gates, joins, schema, scoring, sentiment, tagging
from tidemark.plans import market
from tidemark.sources import readers, sinks, stores


def test_aliases_are_chosen_per_column(spark):
    df = spark.createDataFrame([(None, "b", 1), ("x", None, 2)], "title string, name string, id int")
    got = schema.resolved(df, {"title": ("title", "name"), "key": ("key", "id"), "none": ("no",)}, {"none": "d"}).collect()
    assert [tuple(r) for r in got] == [(None, 1, "d"), ("x", 2, "d")]
    empty = df.withColumn("title", F.lit(None).cast("string"))
    assert [r[0] for r in empty.select(schema.filled(empty, ["title", "name"])).collect()] == ["b", None]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, " nan ")], "`A b` int, `a-B` int, `C.` string")
    got = schema.normal_cells(schema.normal_names(df))
    assert got.columns == ["a_b", "a_b_1", "c"] and got.first()["c"] is None
    with pytest.raises(ValueError):
        schema.required(df, ["zzz"])


def test_latest_row_and_nulls(spark):
    df = spark.createDataFrame([("k", None, 1, 1), ("k", 5, 1, 2), ("k", 5, 2, 3), (None, 1, 1, 4)], "k string, t int, c int, i int")
    win = dedupe.keep_latest(df, ["k"], "t", "c", [F.col("i").asc()])
    lose = dedupe.keep_latest(df, ["k"], "t", "c", [F.col("i").asc()], "lose")
    assert sorted(r.i for r in win.collect()) == [1, 4] and sorted(r.i for r in lose.collect()) == [3, 4]


def test_best_text(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", "Hi there!", None, 1), ("a", "hi   there", t(1), 2), ("a", "HI there", t(2), 3), ("a", "x", None, 4), ("a", "x!!", None, 5), ("b", "x", None, 6)]
    got = dedupe.best_by_text(spark.createDataFrame(rows, "k string, body string, at timestamp, i int"), "k", "body", "at", [F.col("i").asc()])
    assert sorted(r.i for r in got.collect()) == [3, 5, 6]


def test_blank_ids_are_exempt(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("a", "", 3), ("a", None, 4)], "k string, r string, i int")
    assert sorted(r.i for r in dedupe.first_by_id(df, ["k"], "r", [F.col("i").asc()]).collect()) == [1, 3, 4]


def test_weighted_mean_without_weight(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 0), ("b", None, 2), ("b", 4.0, 2)], "k string, v double, w int")
    got = {r.k: r.v for r in aggregate.weighted_rollup(df, ["k"], "w", ["v"], []).collect()}
    assert got == {"a": 2.0, "b": 2.0}


def test_agreement(spark):
    rows = [(i, m, v) for i, (a, b) in enumerate([(1, 1), (0, 0), (1, 0), (1, 1)]) for m, v in (("a", a), ("b", b))]
    got = aggregate.rater_agreement(spark.createDataFrame(rows, "i int, m string, v int"), ["i"], "m", "v").collect()
    assert [tuple(r) for r in got] == [("a", "b", 0.5, 4)]
    same = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "i int, m string, v int")
    assert aggregate.rater_agreement(same, ["i"], "m", "v").first()["kappa"] is None


def test_top_items_ties_by_first_occurrence(spark):
    df = spark.createDataFrame([("a", 1, ["y", "x"]), ("a", 2, ["x", "z", "y"])], "k string, s int, l array<string>")
    assert aggregate.top_items(df, ["k"], F.col("l"), ["s"], 2).first()["top_items"] == "y; x"


def test_tags_and_reasons(spark):
    df = spark.createDataFrame([("A Pomodoro timer with reminders",), (None,)], "t string")
    assert df.select(tagging.tags(F.col("t"))).first()[0] == ["timer", "pomodoro", "reminders"]
    got = df.select(gates.reasons({"no_text": F.col("t").isNotNull(), "short": F.length("t") > 3})).collect()
    assert [r[0] for r in got] == [None, "no_text,short"]
    assert df.select(tagging.neurodiverse(F.col("t"), F.lit("my ADHD"))).first()[0]


def test_filter_that_empties_keeps_all(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert gates.filtered_or_all(df, gates.included(F.col("t"), ["zzz"], [])).count() == 2


def test_flatten_shapes(spark):
    rows = [(1, '["A", {"name": "B"}]'), (2, '{"features": [{"feature": "C", "label": "against"}], "goldilocks_support": {"c": "support"}}'), (3, "{}"), (4, "bad"), (5, '{"items": ["D"], "support": " strong_support "}'), (6, None)]
    got = flatten.flattened(spark.createDataFrame(rows, "k int, answer string"), ["k"]).orderBy("k", "feature").collect()
    assert [tuple(r) for r in got] == [(1, "A", "a", "neutral"), (1, "B", "b", "neutral"), (2, "C", "c", "against"), (3, "", "", "neutral"), (5, "D", "d", "strong_support")]


def test_enrichment_failures_are_rows(spark):
    def client(p):
        if "bad" in p:
            raise RuntimeError("no")
        return p.upper()

    df = spark.createDataFrame([("a",), ("bad",), ("a",)], "p string")
    assert sorted((r.answer, r.failed) for r in enrich.answered(df, "p", client, "stub").collect()) == [("A", False), ("A", False), ("stub", True)]
    assert all(r.failed for r in enrich.answered(df, "p", None).collect())


def test_sentiment_engines(spark):
    df = spark.createDataFrame([("I love it, great!",), ("awful crash",), ("table",), (None,)], "t string")
    got = [r.sentiment_label for r in sentiment.with_sentiment(df, "t").collect()]
    assert got == ["positive", "negative", "neutral", "neutral"]
    assert [r[0] for r in df.select(sentiment.keyword_label(F.col("t"))).collect()] == ["Positive", "Negative", "Neutral", "Neutral"]


def test_joins_do_not_fan_out(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "w")], "k int, v string")
    got = joins.one_to_one(left, right, ["k"], [F.col("v").asc()]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", "w"), (2, "b", None)]
    assert [r.k for r in joins.not_done(left, right, ["k"]).collect()] == [2]


def test_catalog_from_mixed_records(spark, tmp_path):
    raw = spark.createDataFrame(
        [("PlayStore", "com.a", "Focus Timer", "10M+", "$1.00 - $2.00", "Sep 12, 2025", 4.5, None), ("PlayStore", "com.a", "Focus Timer", "5M+", None, None, 4.0, "study timer"), ("cws", "b", "x", "5 users", None, None, None, None)],
        "store string, id string, title string, installs string, pricing_raw string, updated string, score double, summary string",
    )
    got = market.normalized(raw, dt.date(2025, 10, 1))
    assert got.columns == list(market.CATALOG)
    first = got.where("last_update is not null").first()
    assert (first.app_key, first.installs_or_users, first.iap_min, first.iap_max, str(first.last_update)) == ("play:com.a", 10_000_000, 1.0, 2.0, "2025-09-12")
    done = market.checked(got)
    sinks.split_tables(done, f"{tmp_path}/kept", f"{tmp_path}/dropped")
    assert [r.app_key for r in spark.read.parquet(f"{tmp_path}/kept").collect()] == ["play:com.a"]
    assert [r.drop_reason for r in spark.read.parquet(f"{tmp_path}/dropped").collect()] == ["missing_title_and_description,below_popularity_thresholds,low_relevance"]


def test_reviews_to_cards(spark, tmp_path):
    apps = spark.createDataFrame([("play:a", "PlayStore", "Timer app", "a pomodoro timer", "tools", "me")], "app_key string, store string, title string, description string, category string, developer string")
    web = spark.createDataFrame([], "app_key string, website_text string")
    rev = spark.createDataFrame([("play:a", "PlayStore", "us", "great", "love the timer", 5, True), ("play:a", "PlayStore", "de", None, "bad timer crash", 1, False)], "app_key string, store string, country string, title string, body string, rating int, special_reviews boolean")
    long = market.features_long(apps, web, rev, least_hits=1)
    assert {r.feature: (r.confidence, r.review_hits, r.flag) for r in long.collect()} == {"timer": (0.8, 2, 1), "pomodoro": (0.6, 0, 0)}
    mood = aggregate.sentiment_by_app(market.scored_reviews(rev), ["app_key", "store", "country"])
    labels = spark.createDataFrame([("play:a", "pain", "speed; price", 1), ("play:a", "praise", "speed", 2)], "app_key string, type string, aspects string, i int")
    card = market.cards(apps, long, mood, market.review_insights(labels, "i"), ["timer", "pomodoro"]).first()
    assert (card.timer, card.pomodoro, card.n_reviews, card.pains, card.top_aspects) == (1, 0, 2, 1, "speed; price")
    assert market.bundle(long, apps, mood).count() == 2
    sinks.matrices(long.select("app_key", "feature", "flag", "confidence", "review_hits"), str(tmp_path), ["timer", "pomodoro"])
    assert spark.read.parquet(f"{tmp_path}/features_matrix_review_hits").first()["timer"] == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"b": "x"}\n')
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "features_timer.csv").write_text('k,v\n1,"x\ny"\n')
    assert readers.load_any(spark, f"{tmp_path}/a.jsonl").count() == 2
    assert readers.load_any(spark, f"{tmp_path}/a.json").count() == 2
    assert readers.load_any(spark, f"{tmp_path}/features_timer.csv").first()["v"] == "x\ny"
    assert readers.optional(spark, f"{tmp_path}/none.csv", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.load_any(spark, f"{tmp_path}/none.csv")
    named = readers.named_files(spark, [f"{tmp_path}/features_*.csv"], "k int, v string", manifest=["timer"])
    assert {r.feature for r in named.collect()} == {"timer"}


def test_long_table_from_files(spark, tmp_path):
    (tmp_path / "features_timer.csv").write_text("app_key,title,confidence,signals,review_hits,flag\nPlayStore::a,x,0.8,title,7,\nplay:a,x,0.6,title,1,\nios:id5,y,bad,,,1\n")
    (tmp_path / "features_long_llm.csv").write_text("app_key,title,confidence,signals,review_hits,flag\nplay:a,x,1,,1,1\n")
    got = market.features_from_files(spark, [f"{tmp_path}/features_*.csv"], ["timer"]).orderBy("app_key").collect()
    assert [tuple(r) for r in got] == [("ios:5", "timer", 1, 0.0, 0), ("play:a", "timer", 1, 0.8, 7)]


def test_store_pages(spark):
    page = '<title>App</title><a href="/x?id=com.b">b</a><a href="/x?id=com.a">a</a><div>Updated on</div><div>Sep 12, 2025</div><div>4.6 out of 5</div><a href="https://site.example/">s</a>'
    df = spark.createDataFrame([("com.a", "https://store/a", page)], "id string, url string, html string")
    got = stores.play_records(df, "id", "url", "html").first()
    assert (got.app_key, got.title, got.last_update, got.rating_avg, got.website_url) == ("play:com.a", "App", "2025-09-12", 4.6, "https://site.example/")
    assert [r.id for r in stores.related(df, "id", "html", 5).collect()] == ["com.b"]
    feed = '{"feed": {"entry": [{"id": {"label": "app"}}, {"id": {"label": "7"}, "im:rating": {"label": "4"}, "content": {"label": "ok"}}]}}'
    rev = stores.ios_reviews(spark.createDataFrame([("9", "us", feed)], "a string, c string, b string"), "a", "c", "b").collect()
    assert [(r.app_key, r.review_id, r.rating, r.body) for r in rev] == [("ios:9", "7", 4, "ok")]


def test_relevance_is_clamped(spark):
    df = spark.createDataFrame([("focus timer " * 50,), ("wallpaper game",), (None,)], "t string")
    score = scoring.relevance({"title": F.col("t")}, F.lit("PlayStore"), F.lit(0), F.lit(0), F.lit(None).cast("date"), dt.date(2025, 1, 1))
    assert [r[0] for r in df.select(score).collect()] == [1.0, 0.0, 0.0]
    assert "deep focus" in scoring.Weights().plus([" Deep Focus "]).include_terms
