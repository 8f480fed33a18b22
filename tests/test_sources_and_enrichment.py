"""Readers, writers, small column tools and model enrichment, on files and rows made here."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html, text
from tidemark.operators import aggregate, enrich, gates, ordering, phrases, schema, scoring, sentiment, tagging
from tidemark.plans import market
from tidemark.sources import readers, sinks, stores


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_csv_as_text_and_projected(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,2.5,"x, y"\n007,,z\n')
    assert readers.load_any(spark, f"{tmp_path}/a.csv").dtypes == [("a", "int"), ("b", "double"), ("c", "string")]
    as_text = readers.load_any(spark, f"{tmp_path}/a.csv", as_text=True)
    assert {t for _, t in as_text.dtypes} == {"string"} and [r.a for r in as_text.collect()] == ["1", "007"]
    got = readers.present(as_text, ["c", "nope", "a"])
    assert got.columns == ["c", "a"] and "b" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_optional_and_config(spark, tmp_path):
    assert readers.optional(spark, f"{tmp_path}/none.parquet", "a int").count() == 0
    (tmp_path / "bad.parquet").write_text("not parquet at all")
    with pytest.raises(Exception):
        readers.optional(spark, f"{tmp_path}/bad.parquet", "a int").count()
    (tmp_path / "c.json").write_text('{"keywords": ["a"], "n": 2}')
    assert readers.config(spark, f"{tmp_path}/c.json") == {"keywords": ["a"], "n": 2}


def test_seeds_and_review_fallback(spark, tmp_path):
    assert sorted(tuple(r) for r in readers.seeds(spark, {"PlayStore": ["a", "b"], "AppStore": ["1"]}).collect()) == [("AppStore", "1"), ("PlayStore", "a"), ("PlayStore", "b")]
    spark.createDataFrame([("x",)], "body string").write.parquet(f"{tmp_path}/second.parquet")
    got = readers.reviews(spark, f"{tmp_path}/first.parquet", f"{tmp_path}/second.parquet", "body string", "play").collect()
    assert [tuple(r) for r in got] == [("x", "play")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "k int, l array<string>")
    for _ in range(2):
        sinks.append(sinks.flat_lists(df), f"{tmp_path}/csv", "csv")
    back = readers.csv(spark, f"{tmp_path}/csv")
    assert back.count() == 4 and {r.l for r in back.collect()} == {"a,b", None}
    sinks.json_lines(df, f"{tmp_path}/json")
    assert sorted(r.k for r in readers.json_lines(spark, f"{tmp_path}/json").collect()) == [1, 2]
    sinks.overwrite(df, f"{tmp_path}/parts", by=["k"])
    assert spark.read.parquet(f"{tmp_path}/parts").where("k = 2").count() == 1


def test_column_tools(spark):
    df = spark.createDataFrame([("a", 1)], "Feature_Name string, n int")
    got = schema.with_defaults(df, {"n": 9, "extra": "x"})
    assert got.columns == ["Feature_Name", "n", "extra"] and got.first()["n"] == 1
    assert schema.wanted(df, ["n", "zzz"]).columns == ["n"]
    assert schema.by_prefix(df, "feature") == "Feature_Name" and schema.by_part(df, "zzz", "name") == "Feature_Name" and schema.by_prefix(df, "q") is None


def test_html_forms(spark):
    assert values(spark, ["a  \nb\t\n c"], html.trimmed) == ["a\nb\n c"] and values(spark, ["x" * 20], lambda c: html.trimmed(c, 5)) == ["xxxxx"]
    assert values(spark, ["one\ntwo\nDetails\nthree", "Details matter", None], html.section) == ["one\ntwo", "Details matter", ""]
    df = spark.createDataFrame([("abcd", "x", 3), ("ab", "xyz", 3), ("ab", None, 3), (None, None, 3)], "a string, b string, n int")
    assert [r[0] for r in df.select(html.longer_of(F.col("a"), F.col("b"), 3)).collect()] == ["abcd", "xyz", "ab", ""]
    pages = ['<a href="https://play.google.com/x">g</a><a class=b href="https://me.example/"> <span>Website</span></a>', "<div>Website</div><div>me.example/x</div>", '<a href="https://else.example/">y</a>', "none", None]
    assert values(spark, pages, html.website) == ["https://me.example/", "https://me.example/x", "https://else.example/", None, None]


def test_labelled_sections(spark):
    df = spark.createDataFrame([("A", " ", "c" * 20)], "a string, b string, c string")
    got = df.select(text.labelled_sections({"Title": F.col("a"), "Body": F.col("b"), "More": F.col("c")}, 20)).first()[0]
    assert got == "Title: A\n\nMore: cccc"


def test_filters_before_roll_ups(spark):
    rows = [("a", None, "good app", 5, True), ("a", None, "table", 3, False), ("a", None, "bad app", 1, None)]
    df = spark.createDataFrame(rows, "app_key string, title string, body string, rating int, special_reviews boolean")
    assert market.scored_reviews(df, special_only=True).count() == 1
    kept = aggregate.sentiment_by_app(market.scored_reviews(df), ["app_key"], "neutral").first()
    assert (kept.n_reviews, kept.n_nd, kept.pct_positive) == (2, 1, 0.5)


def test_engines_by_name():
    assert sentiment.engine("VADER") is sentiment.engine(None) is sentiment.engine("lexicon") is sentiment.valence_score
    assert sentiment.engine("keywords") is not sentiment.valence_score
    with pytest.raises(ValueError):
        sentiment.engine("lexcion")


def test_phrases_need_whole_words(spark):
    w = scoring.Weights()
    rows = ["site blocker", "site blockers", "on screen timers", "screen time", "ÉSCREEN TIME".lower(), None]
    assert values(spark, rows, lambda c: phrases.term_sums(F.lower(c), [(w.include_phrases, True)])[0]) == [1, 0, 0, 1, 0, 0]
    assert values(spark, ["study timer, block", "blockchain studying", "focus focused focus"], lambda c: phrases.term_sums(c, [(w.include_terms, False)])[0]) == [4, 0, 3]


def test_recency_is_configurable(spark):
    import datetime as dt

    day, df = F.lit(dt.date(2024, 12, 1)), spark.range(1)
    score = lambda w: df.select(scoring.relevance({"title": F.lit("x")}, F.lit("s"), F.lit(0), F.lit(0), day, dt.date(2025, 1, 1), w)).first()[0]
    assert score(scoring.Weights()) == 0.1 and score(scoring.Weights(recency=(10, 20, 0.5, 0.1))) == 0.0 and score(scoring.Weights(recency=(60, 90, 0.5, 0.1))) == 0.5


def test_orders(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, "4.5", "a"), (3, "10", "a")], "k int, rating_avg string, title string")
    assert [r.k for r in df.orderBy(*ordering.chosen_order("Rating, low to high", ["k"])).collect()] == [2, 3, 1]
    assert [r.k for r in df.orderBy(*ordering.ordering(("title", "asc"), ("k", "desc"))).collect()] == [3, 2, 1]
    assert ordering.capped(df, None, [F.col("k")]).count() == 3 and [r.k for r in ordering.capped(df, 1, [F.col("k").desc()]).collect()] == [3]
    with pytest.raises(ValueError):
        ordering.ordering(("k", "up"))


def test_failures_have_reasons(spark):
    got = spark.createDataFrame([("PlayStore", "a", "T"), ("PlayStore", "b", None)], "store string, id string, title string")
    wanted = spark.createDataFrame([("PlayStore", "a"), ("PlayStore", "b"), ("PlayStore", "c"), ("X", "d"), ("PlayStore", None), (None, "e")], "store string, id string")
    kept, failed = stores.records(wanted, {"PlayStore": got})
    assert [r.id for r in kept.collect()] == ["a"]
    assert {(r.store, r.id): r.failure for r in failed.collect()} == {("PlayStore", "b"): "no title", ("PlayStore", "c"): "no page", ("X", "d"): "unknown store", ("PlayStore", None): "no id", (None, "e"): "unknown store"}


def test_records_without_keys_stay_apart(spark):
    raw = spark.createDataFrame([("PlayStore", None, "First app", 99), ("PlayStore", None, "Second app", 99)], "store string, id string, title string, ratings int")
    import datetime as dt

    got = market.checked(market.normalized(raw, dt.date(2025, 1, 1)))
    assert sorted(r.title for r in got.collect()) == ["First app", "Second app"]


def test_enrichment_asks_parses_and_resumes(spark):
    def client(prompt):
        if "broken" in prompt:
            raise RuntimeError("no")
        if "Review: " in prompt:
            return 'Sure: {"type": "pain", "aspects": ["price", "speed"]}'
        if prompt.startswith("Name the subject"):
            return '```json\n{"label": "timers", "confidence": 0.75}\n```'
        if prompt.startswith("Sort this"):
            return json.dumps({"features": [{"name": "Timer", "category": "focus", "support": "supportive", "nd_specific": True}]})
        if prompt.startswith("Say for each"):
            return '{"timer": {"present": true, "confidence": 0.9}}'
        return '["Timer", {"name": "Blocker"}]'

    todo = spark.createDataFrame([("a", "fine"), ("b", "broken"), ("c", "done before")], "app_key string, t string")
    done = spark.createDataFrame([("c",)], "app_key string")
    run = lambda name, section, **more: enrich.enriched(name, todo, ["app_key"], {section: F.col("t")}, client, done, **more).collect()
    assert sorted(tuple(r) for r in run("reviews", "Review")) == [("a", False, "pain", "price; speed"), ("b", True, None, "")]
    assert sorted((r.app_key, r.failed, r.label, r.confidence) for r in run("classify", "Text")) == [("a", False, "timers", 0.75), ("b", True, None, None)]
    assert [(r.app_key, r.feature_name, r.support_val, r.nd_specific) for r in run("taxonomy", "Description")] == [("a", "Timer", 1, True)]
    assert sorted((r.app_key, r.feature, r.present) for r in run("flags", "Description", features=["timer", "other"])) == [("a", "other", 0), ("a", "timer", 1), ("b", "other", 0), ("b", "timer", 0)]
    assert sorted((r.app_key, r.feature_norm) for r in run("features", "Title")) == [("a", "blocker"), ("a", "timer"), ("b", "")]
    assert all(r.failed for r in enrich.enriched("classify", todo, ["app_key"], {"Text": F.col("t")}, None).collect())
    with pytest.raises(ValueError):
        enrich.templated("classify", {"Nope": F.lit("x")})


def test_patterns_of_features(spark):
    shown = {
        "timer": "count down", "pomodoro": "25 min", "habit_tracking": "check ins", "focus_mode": "flow state", "screen_time": "usage limits", "parental_control": "block apps for kids", "adhd_support": "neuro diversity",
        "reminders": "notify me", "analytics": "time breakdown", "gamification": "gamified", "rewards": "allowance", "calendar_integration": "iCal", "todo_integration": "integrations with todoist", "browser_extension": "Chrome add-on",
        "web_filtering": "gambling filter", "whitelist_blacklist": "denylist", "scheduling": "app limits", "cross_device_sync": "synchronise", "focus_music_noise": "pink noise", "blocking": "reels blocker",
    }
    assert set(shown) == set(tagging.DOMAIN)
    df = spark.createDataFrame(list(shown.items()), "name string, t string")
    assert all(r.name in r.tags for r in df.select("name", tagging.tags(F.col("t")).alias("tags")).collect())
    assert values(spark, ["blocks blockchain", "addition", "éadd", "nothing", None], tagging.tags) == [[], [], [], [], []]
    assert gates.split(df.withColumn("drop_reason", F.lit(None).cast("string")))[0].count() == len(shown)
