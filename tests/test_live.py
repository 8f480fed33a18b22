"""The live table, tables of committed batches and paged sources: stops, restarts and repeats change nothing."""

import json
import random
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import calls, dedupe
from tidemark.sources import committed, paged, stores
from tidemark.streaming import feed, live

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test
SCHEMA = "app string, rid string, title string, body string, at timestamp, seq long"


def made(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        body = " ".join(rnd.choice(["Good", "bad!", "fine", "slow"]) for _ in range(rnd.randint(0, 2)))
        rows.append((rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, "", *map(str, range(n // 2))]), rnd.choice([None, "T"]), rnd.choice([body, body.upper(), body + "  ", None]), rnd.choice([None, rnd.randint(0, 20)]), i))
    return spark.createDataFrame(rows, SCHEMA.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at"))


def batch_result(rows):
    """The same in one batch, by windows."""
    once = dedupe.first_by_id(rows, ["app"], "rid", [F.col("seq").asc()])
    once = once.withColumn("both", F.concat_ws(" ", text.text_or_blank(F.col("title")), text.text_or_blank(F.col("body"))))
    marked = once.withColumn("h", text.review_hash(F.col("app"), F.col("both")))
    size = F.when(F.col("at").isNull(), F.length(text.text_or_blank(F.col("body"))))
    return sorted(r.seq for r in dedupe.top_rows(marked, ["h"], [F.col("at").desc_nulls_last(), size.desc_nulls_last(), F.col("seq").asc()]).collect())


def test_live_table_equals_batch(spark, tmp_path):
    root, rows = f"file://{tmp_path}", made(spark, 300)
    for k in range(6):  # arrive in order, in several runs of the feed
        rows.where((F.col("seq") >= 50 * k) & (F.col("seq") < 50 * k + 50)).repartition(3).write.mode("append").parquet(f"{root}/in")
        changes = live.standing_changes(feed.feed(spark, f"{root}/in", rows.schema), "app", "rid", "body", "at", "seq", "title", buckets=8)
        q = live.start(changes, f"{root}/t", f"{root}/state")
        q.awaitTermination()
        if k == 3:
            assert live.compact(spark, f"{root}/t", changes.schema) and len(committed.entries(spark, f"{root}/t")) == 1
    got = live.standing(spark, f"{root}/t", changes.schema)
    assert sorted(got.columns) == sorted(rows.columns)
    assert sorted(r.seq for r in got.collect()) == batch_result(rows)
    ids = rows.where("trim(rid) <> ''").select("app", "rid").distinct().count()
    held = q.lastProgress.stateOperators
    assert [o.numRowsTotal for o in held][1] == ids  # the ids, and nothing else, one by one
    n = got.count()
    assert live.compact(spark, f"{root}/t", changes.schema) and sorted(r.seq for r in live.standing(spark, f"{root}/t", changes.schema).collect()) == batch_result(rows)
    assert not live.compact(spark, f"{root}/t", changes.schema) and committed.swept(spark, f"{root}/t") > 0 and live.standing(spark, f"{root}/t", changes.schema).count() == n


def test_live_batch_that_is_run_again_is_there_once(spark, tmp_path, monkeypatch):
    root, rows = f"file://{tmp_path}", made(spark, 60, 2)
    rows.coalesce(1).write.parquet(f"{root}/in")

    def run():
        changes = live.standing_changes(feed.feed(spark, f"{root}/in", rows.schema), "app", "rid", "body", "at", "seq", "title", buckets=4)
        q = live.start(changes, f"{root}/t", f"{root}/state")
        q.awaitTermination()
        return changes

    entered = committed.append

    def stopped_after(*a):
        entered(*a)
        raise RuntimeError("stopped")

    monkeypatch.setattr(committed, "append", stopped_after)
    with pytest.raises(Exception, match="stopped"):
        run()
    monkeypatch.setattr(committed, "append", entered)
    changes = run()
    assert len(committed.entries(spark, f"{root}/t")) == 1 and sorted(r.seq for r in live.standing(spark, f"{root}/t", changes.schema).collect()) == batch_result(rows)
    more = made(spark, 60, 2).withColumn("seq", F.col("seq") + 1000)
    more.coalesce(1).write.mode("append").parquet(f"{root}/in")
    run()
    assert sorted(r.seq for r in live.standing(spark, f"{root}/t", changes.schema).collect()) == batch_result(rows.unionByName(more))


def test_committed_batches(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    df = spark.range(10).repartition(2)
    assert committed.read(spark, root, "id long").count() == 0 and not committed.compacted(spark, root, "id long")
    assert committed.append(df, root, "b1") and not committed.append(df, root, "b1")
    df.write.parquet(f"{root}/data/b2-half")  # a batch that was stopped before its entry
    assert committed.read(spark, root, "id long").count() == 10
    assert committed.append(df.where("id < 3"), root, "b2") and committed.read(spark, root, "id long").count() == 13
    done = []
    writers = [threading.Thread(target=lambda: done.append(committed.append(df, root, "b3"))) for _ in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(done) == [False, False, False, True] and committed.read(spark, root, "id long").count() == 23
    assert committed.compacted(spark, root, "id long", lambda rows: rows.distinct()) and committed.read(spark, root, "id long").count() == 10
    assert not committed.append(df, root, "b1")  # a replaced batch is still known
    assert committed.append(df, root, "b4") and committed.read(spark, root, "id long").count() == 20
    assert committed.swept(spark, root) >= 4 and committed.read(spark, root, "id long").count() == 20


def review(i):
    return {"reviewId": f"r{i}", "userName": "u", "content": f"text {i}", "score": 4, "reviewCreatedVersion": None, "at": "2024-01-01T00:00:00Z"}


class Pages:
    """Ten pages of three reviews for each feed; page 4 fails ``fails`` times, or always where that is negative. What fails is counted
    in files, since every task has an object of its own."""

    def __init__(self, folder, fails=1):
        self.folder, self.fails = str(folder), fails

    def __call__(self, app, country, token):
        import os

        n = int(token or 0)
        with open(f"{self.folder}/calls", "a") as f:
            f.write(f"{app} {n}\n")
        mark = f"{self.folder}/{app}-{country}-failed"
        if n == 4 and app != "dead" and (self.fails < 0 or not os.path.exists(mark) or os.path.getsize(mark) < self.fails):
            with open(mark, "a") as f:
                f.write("x")
            raise OSError("page 4")
        if app == "dead":
            raise OSError("no such app")
        return json.dumps([review(f"{app}-{country}-{3 * n + k}") for k in range(3)]), str(n + 1) if n < 9 else None


FEEDS = [("a", "us"), ("a", "de"), ("b", "us"), ("dead", "us")]


def wanted(feeds, n=30):
    return sorted(f"r{a}-{c}-{k}" for a, c in feeds if a != "dead" for k in range(n))


def test_paged_batch(spark, tmp_path):
    got = paged.pages(spark, Pages(tmp_path), FEEDS, name="p1", pause=0.01, pages=10).cache()
    assert got.rdd.getNumPartitions() == 4
    reviews = stores.play_reviews(got.where("error is null"), "app_id", "country", "body")
    assert sorted(r.review_id for r in reviews.collect()) == wanted(FEEDS)
    assert [(r.app_id, r.page, r.body) for r in got.where("error is not null").collect()] == [("dead", 0, None)]
    limited = paged.pages(spark, Pages(tmp_path), FEEDS[:1], name="p2", pages=2)
    assert sorted(r.page for r in limited.collect()) == [0, 1]


def test_paged_stream_resumes_at_its_token(spark, tmp_path):
    root = f"file://{tmp_path}"
    fetch = Pages(tmp_path, fails=3)  # fails through a whole round of two attempts

    def run(feeds=FEEDS):
        got = paged.pages(spark, fetch, feeds, stream=True, name="p3", pause=0.01, attempts=2, rounds=3, batch_pages=3, ledger=f"{root}/ledger")
        return got.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(lambda b, n: committed.append(b, f"{root}/pages", f"{n:04d}") or None).start()

    q = run()
    while not committed.entries(spark, f"{root}/pages"):  # stop after a batch or so
        q.awaitTermination(1)
    q.stop()
    before = len((tmp_path / "calls").read_text().split("\n"))
    assert before < 80
    paged.drained(run())
    got = committed.read(spark, f"{root}/pages", paged.SCHEMA)
    reviews = stores.play_reviews(got.where("error is null"), "app_id", "country", "body")
    assert sorted(r.review_id for r in reviews.collect()) == wanted(FEEDS)
    assert [(r.app_id, r.page) for r in got.where("error is not null").collect()] == [("dead", 0)]
    calls = (tmp_path / "calls").read_text().split("\n")
    assert calls.count("b 0") <= 2 and calls.count("b 9") <= 2  # no feed was read from its beginning again
    n = len(calls)
    paged.drained(run())  # nothing is left
    assert len((tmp_path / "calls").read_text().split("\n")) == n
    # the pages' reviews feed the live table
    reviews.withColumn("seq", F.monotonically_increasing_id()).write.parquet(f"{root}/in")
    rows = spark.read.parquet(f"{root}/in")
    changes = live.standing_changes(feed.feed(spark, f"{root}/in", rows.schema), "app_key", "review_id", "body", "at", "seq")
    live.start(changes, f"{root}/t", f"{root}/live").awaitTermination()
    assert live.standing(spark, f"{root}/t", changes.schema).count() == 90


def test_retries_pause_longer_each_time():
    waits, left = [], [2]

    def call():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return 7

    assert calls.retried(call, 3, 0.5, waits.append) == 7 and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        left[0] = 5
        calls.retried(call, 2, 0.5, waits.append)
