"""Numbers and order of first sight, whatever the partitions."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import numbering
from tidemark.plans import market
from tidemark.plans.base import shared
from tidemark.sources import stores


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_numbers_follow_the_order(spark, parts):
    shared(spark)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.when(F.col("id") % 10 > 0, F.col("id") % 13).alias("b")).repartition(parts)
    got = [(r.b, r.a, r.n) for r in numbering.numbered(df, ["b", "a"], parts=parts).collect()]
    assert [x[:2] for x in sorted(got, key=lambda x: x[2])] == sorted((x[:2] for x in got), key=lambda x: (x[0] is not None, x)) and sorted(x[2] for x in got) == list(range(1000))
    assert numbering.numbered(df.where("false"), ["a"]).count() == 0
    same = numbering.numbered(df.select(F.lit(1).alias("a")), ["a"], first=5)  # one value holds all rows
    assert sorted(r.n for r in same.collect()) == list(range(5, 1005))


def test_records_without_ids_keep_their_keys(spark):
    shared(spark)
    rows = [(None, f"title {i % 40}", "PlayStore", None if i % 3 else str(i), 100 + i % 40) for i in range(90)]
    df = spark.createDataFrame(rows, "app_key string, title string, store string, id string, rating_count long").withColumns({"installs_or_users": F.lit(1), "description": F.lit("d"), "scraped_at": F.lit(None).cast("date"), "relevance_score": F.lit(1.0)})
    got = [sorted((r.app_key, r.title, r.rating_count) for r in market.checked(df.repartition(n)).collect()) for n in (1, 7, 50)]
    assert got[0] == got[1] == got[2] and {k for k, *_ in got[0] if k.startswith("row:")} == {f"row:{i}" for i in range(60)} and len(got[0]) == 90


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_first_sight(spark, parts):
    a = spark.createDataFrame([(i, k) for i, k in enumerate("cabcad")], "i long, k string").repartition(parts)
    b = spark.createDataFrame([(i, k) for i, k in enumerate("zdya")], "i long, k string").repartition(parts)
    assert [r.k for r in numbering.distinct_in_order([(a, ["i"]), (b, ["i"])], ["k"]).collect()] == list("cabdzy")
    link = "".join  # pages of links
    pages = spark.createDataFrame([(w, link(f'<a href="/store/apps/details?id=com.{x}">x</a>' for x in ids)) for w, ids in (("b", "qpz"), ("a", "zyp"), ("c", "pk"))], "word string, html string").repartition(parts)
    assert [r.id for r in stores.discovered(pages, "play", "word", "html").collect()] == [f"com.{x}" for x in "zypqk"]
    assert [r.id for r in stores.discovered(pages, "play", "word", "html", 2).collect()] == [f"com.{x}" for x in "zyqpk"]


def test_cards_of_bucketed_tables_move_nothing(spark, sf):
    from tidemark.plans.registry import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES["bucketed_cards"](spark, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 3 and plan.count("Bucketed: true") >= 4
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, QUERIES["app_cards"](spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
