"""Scalar functions on small rows, nulls and blanks included."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates, html, jsonx, numbers, text


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "f, rows, want",
    [
        (numbers.scaled, ["742K", "10M+", "10,000,000+ downloads", "1.5k", "none", "", None], [742000, 10000000, 10000000, 1500, None, None, None]),
        (numbers.compact, ["8.4K", "600,000", "1.2M", "about 12", "", None], [8400, 600000, 1200000, 12, None, None]),
        (numbers.users, ["600,000 users", "1.2K Users here", "users", None], [600000, 1200, None, None]),
        (numbers.first_digits, ["1,234 x 9", "x", None], [1234, None, None]),
        (text.feature_name, ["  A \t b ", None, ""], ["a b", "", ""]),
        (text.slug, ["Hello, World!", "--", None], ["hello-world", "", ""]),
        (text.store_name, [" ios ", "Android", "cws", "Other", None], ["AppStore", "PlayStore", "ChromeWS", "Other", None]),
        (text.without_urls, ["see https://x.y/z now", None], ["see now", ""]),
        (text.review_form, ["Très BIEN!!! www.a.b", None], ["très bien", ""]),
        (text.developer_name, ["Acme Ltd, 5 Road", "Acme 12345 Street", "Trader notice", None], ["Acme Ltd", "Acme", "Trader notice", None]),
        (text.literal_list, ["['A', ' b ']", "[]", "nonsense", None], [["a", "b"], [], None, None]),
        (dates.iso_or_raw, ["Sep 12, 2025", "September 17, 2025", "2025-01-02", "Flag  concern", "", None], ["2025-09-12", "2025-09-17", "2025-01-02", "Flag concern", None, None]),
        (html.page_title, ["<title> A &amp; b\n</title>", "<p>", None], ["A & b", None, None]),
        (html.visible_text, ["<p>a</p><script>x</script><b>b&lt;</b>", "", None], ["a\nb<", "", ""]),
        (html.web_url, ["example.com/a", "http://a.b", "mailto:x@y.z", "localhost", " ", None], ["https://example.com/a", "http://a.b", None, None, None, None]),
        (html.links, ['<a href="/x">1</a><A class=c href=\'y?id=z\'>', None], [["/x", "y?id=z"], []]),
        (html.play_id, ["/store/apps/details?id=com.a.b&hl=en", "/x", None], ["com.a.b", None, None]),
        (jsonx.unfenced, ["```json\n{}\n```", " {} ", None], ["{}", "{}", ""]),
    ],
)
def test_columns(spark, f, rows, want):
    assert values(spark, rows, f) == want


def test_prices(spark):
    got = values(spark, ["$0.99 - $21.99 per item", "€5", "free", None], lambda c: F.struct(*numbers.price_range(c)))
    assert [tuple(g) for g in got] == [(0.99, 21.99, 2), (5.0, 5.0, 1), (None, None, 0), (None, None, 0)]


def test_score_bins_and_polarity(spark):
    rows = [-1.0, -0.5, -0.05, 0.0, 0.05, 0.06, 1.0, None]
    assert values(spark, rows, numbers.score_bin, "double") == [None, "Negative", "Negative", "Neutral", "Neutral", "Positive", "Positive", None]
    assert values(spark, rows, numbers.polarity, "double") == ["negative", "negative", "negative", "neutral", "positive", "positive", "positive", None]


def test_confidence_ladder(spark):
    df = spark.createDataFrame([(2, 0), (1, 10), (1, 9), (0, 25), (0, 24)], "s int, h int")
    assert [r[0] for r in df.select(numbers.confidence(F.col("s"), F.col("h"))).collect()] == [0.80, 0.70, 0.60, 0.55, 0.0]


def test_keys_round_trip(spark):
    df = spark.createDataFrame([("android", "com.x"), ("ios", "id123"), ("cws", "abc"), ("play", None)], "s string, i string")
    key = text.app_key(F.col("s"), F.col("i"))
    got = df.select(key.alias("k")).select("k", *text.split_key(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("play:com.x", "PlayStore", "com.x"), ("ios:123", "AppStore", "123"), ("cws:abc", "ChromeWS", "abc"), (None, None, None)]


def test_answers_that_are_not_json(spark):
    got = values(spark, ['{"a": 1}', 'so: {"a": 2} done', "nothing", None], lambda c: F.to_json(jsonx.parsed_answer(c)))
    assert got == ['{"a":1}', '{"a":2}', '{"raw_text":"nothing"}', '{"raw_text":""}']


def test_late_rows(spark):
    as_of = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
    rows = ["2024-01-30 00:00:00", "2023-01-01", "soon", None]
    assert values(spark, rows, lambda c: dates.since_or_unread(c, as_of, 10)) == [True, False, True, False]
    assert values(spark, rows, lambda c: dates.since(dates.instant(c), as_of, 10)) == [True, False, False, False]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=20))
def test_numbers_survive_thousands_separators(spark, ns):
    assert values(spark, [f"{n:,}+ installs" for n in ns], numbers.scaled) == ns
