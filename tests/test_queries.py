"""Registered queries on the smallest tables, against their SQL; the feed against its batch form."""

import importlib
import sys

import pytest

import __spark_entry__
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.streaming import feed

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(spark, duck, sf, query, sql):
    df = query(spark, sf)
    cols = sorted(df.columns)
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    order = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    same(spark, duck, sf, QUERIES[name], ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("tidemark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_feed_equals_batch(spark, tmp_path):
    rows = [("a", "1", "x", None, 1), ("a", "1", "y", None, 2), ("a", "2", "X!", None, 3), ("b", "", "x", None, 4), ("b", "", "longer", None, 5), ("a", "3", "x.", None, 6)]
    schema = "k string, r string, body string, at timestamp, seq long"
    df = spark.createDataFrame(rows, schema)
    for i in range(3):
        df.where(f"seq % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: feed.finish(feed.start(feed.feed(spark, f"{tmp_path}/in", schema, files_per_batch=1), f"{tmp_path}/table", f"{tmp_path}/state", ["k"], "r", "seq"))
    run()
    batch = feed.best(feed.once(None, df, ["k"], "r", "seq"), ["k"], "body", "at", "seq")
    assert sorted(r.seq for r in feed.latest(spark, f"{tmp_path}/table", ["k"], "body", "at", "seq").collect()) == sorted(r.seq for r in batch.collect())
    # a restarted feed knows the ids that it has seen
    more = spark.createDataFrame([("a", "1", "z", None, 7), ("a", "4", "new", None, 8), ("a", "4", "again", None, 9)], schema)
    more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    want = feed.best(feed.once(None, df.unionByName(more), ["k"], "r", "seq"), ["k"], "body", "at", "seq")
    assert sorted(r.seq for r in feed.latest(spark, f"{tmp_path}/table", ["k"], "body", "at", "seq").collect()) == sorted(r.seq for r in want.collect())
    assert spark.read.parquet(f"{tmp_path}/table/named").count() == 4
