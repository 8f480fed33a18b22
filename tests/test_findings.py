"""What the findings of round 3 were about."""

from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import aggregate, scoring, tagging
from tidemark.plans import queries_rollup
from tidemark.sources import stores


def test_numbers_in_developers_names_stay(spark):
    names = ["Maker 99, 5 High Road", "Maker 100, 5 High Road", "Studio 3000", "Trader 1234 Games", ", 5 High Road", None]
    rows = [(f"com.a{i}", f"<div>Offered By</div><div>{n}</div>" if n else "<p></p>") for i, n in enumerate(names)]
    pages = spark.createDataFrame(rows, "id string, html string").withColumn("url", F.lit("https://store/"))
    got = {r.id: r.developer for r in stores.play_records(pages, "id", "url", "html").collect()}
    assert [got[f"com.a{i}"] for i in range(len(names))] == ["Maker 99", "Maker 100", "Studio 3000", "Trader 1234 Games", None, None]


def _python_calls(df):
    return sum(line.count("EvalPython") for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "(" in line)


def test_all_fields_of_a_record_go_to_one_python_worker(spark):
    cols = ("title", "category", "description", "developer")
    df = spark.createDataFrame([("Focus timer", "tools", "a site blocker, no camera", None), (None, "", "study timer", "Deep Work")], ", ".join(f"{c} string" for c in cols))
    fields = {c: F.col(c) for c in cols}
    each = df.select(*scoring.field_scores(fields, scoring.Weights()))
    assert _python_calls(each) == 1
    assert [[round(x, 6) for x in r] for r in each.collect()] == [[12.0, 0.0, 2.7, 0.0], [0.0, 0.0, 3.8, 1.2]]
    signals = tagging.feature_signals(df, ["title"], {c: F.col(c) for c in cols[1:]}, spark.createDataFrame([], "title string, feature string, review_hits long"))
    assert _python_calls(signals) == 1


def test_texts_of_a_row_are_searched_apart(spark):
    features = {"any": [r"\b\w+x\b"], "ab": [r"\bab\b"], "cd": [r"\bcd\b"]}
    rows = spark.createDataFrame([(i, "an ox and ab" if i % 3 else None, "cd" if i % 2 else "") for i in range(1000)], "i int, a string, b string")
    for table in (features, {n: features[n] for n in ("ab", "cd")}):
        got = rows.select("i", tagging.tags_each([F.coalesce("a", F.lit("")), F.col("b")], table).alias("t")).collect()
        assert all(r.t == [[n for n in ("any", "ab") if n in table] if r.i % 3 else [], ["cd"] if r.i % 2 else []] for r in got)


def test_dates_are_read_as_by_trying_every_format(spark):
    texts = ["2024-06-01", "Jan 5, 2020", "January 5, 2020", "jan 5, 2020", "2024-06-01T10:11:12Z", "2024-06-01t10:11:12z", "2024-06-01T10:11:12", "2024-06-01 10:11:12", "6/1/2024", "06/01/2024", "1 Jun 2024", "1 June 2024",
             "20240601", "+20240601", "2024061", "202406011", "12024-06-01", "+12024-06-01", "-2024-06-01", " 2024-06-01 ", "2024-13-01", "2024-02-30", "Flag concern", "", None, "5", "Jan 5 2020", "1. Juni 2024", "٢٠٢٤-٠٦-٠١", "2024–06–01", "2024-06-01 x", "1  Jun\t2024", "-", ", "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    tried = F.coalesce(*(F.try_to_timestamp(text.squeeze(text.text_or_blank(F.col("t"))), F.lit(f)).cast("date") for f in dates.FORMATS))
    got = rows.select("t", dates.parsed_date(F.col("t")).cast("string").alias("got"), tried.cast("string").alias("want")).collect()
    assert [r for r in got if r.got != r.want] == [] and sum(r.got is not None for r in got) > 12


def test_dates_of_another_form_are_not_tried(spark):
    """A text is given only to formats whose signs it has: what doesn't fit is slow to find out."""
    forms = {f: dates._may_fit(F.col("t"), f).alias(f) for f in dates.FORMATS}
    rows = spark.createDataFrame([("Flag concern",), ("Jan 5, 2020",), ("20240601",), ("1 Jun 2024",)], "t string")
    assert [sum(r) for r in rows.select(*forms.values()).collect()] == [0, 4, 1, 2]
    always = [dates._may_fit(F.col("t"), f) for f in ("MMMyyyy", "yyyy[-MM]", "EEE, d MMM yyyy")]
    assert rows.select(*always).distinct().collect() == [(True, True, True)]


def test_a_key_computes_its_store_once(spark):
    stores_, ids = ["PlayStore", " Google_Play ", "play", "PLAY", "android", "iOS", "apple", "AppStore", "cws", "Chrome_Web_Store", "Steam", " Steam ", "", None], ["a.b", " id12x ", "id", "", "  ", None]
    rows = spark.createDataFrame([(s, i) for s in stores_ for i in ids], "s string, i string")
    prefix = dict.fromkeys(("playstore", "google_play", "play", "android"), "play") | dict.fromkeys(("ios", "apple", "appstore"), "ios") | dict.fromkeys(("cws", "chrome_web_store"), "cws")

    def want(s, i):
        if not (i or "").strip():
            return None
        p = prefix.get((s or "").strip().lower(), (s or "").lower())
        return f"{p}:{'12' if p == 'ios' and '12' in i else i.strip()}"

    got = rows.select("s", "i", text.app_key(F.col("s"), F.col("i")).alias("k"), text.store_name(F.col("s")).alias("n")).collect()
    assert [(r.s, r.i, r.k) for r in got] == [(r.s, r.i, want(r.s, r.i)) for r in got]
    names = {"play": "PlayStore", "ios": "AppStore", "cws": "ChromeWS"}
    assert all(r.n == (r.s if (r.s or "").strip().lower() == "play" else names.get(prefix.get((r.s or "").strip().lower()), r.s)) for r in got)
    plan = rows.select(text.app_key(F.col("s"), F.col("i")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(regexp_replace(s") <= 2 * plan.count("AS ") + 2


def test_lists_are_made_once_for_their_frequencies(spark, sf):
    assert _python_calls(queries_rollup.list_frequency_topk(spark, sf)) == 1
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), ([None, "b"],)], "x array<string>")
    assert {r.item: r.n for r in aggregate.frequencies(rows, F.col("x")).collect()} == {"a": 2, "b": 2, None: 1}
