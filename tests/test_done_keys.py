"""Resuming by filters: exact results, few bytes moved."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import done_keys
from tidemark.plans.base import shared


def test_filters_know_all_their_keys_and_few_others(spark):
    bits = 1 << 17
    a, b = (spark.range(x, x + 5000).select(F.when(F.col("id") % 1000 > 0, F.col("id").cast("string")).alias("k"), (F.col("id") % 3).alias("j")) for x in (0, 5000))
    both = done_keys.merged(done_keys.filter_of(a, ["k", "j"], bits), done_keys.filter_of(b, ["k", "j"], bits))
    for df in (a, b):
        assert done_keys.marked(df, ["k", "j"], both, bits=bits).where("not known").count() == 0
    others = spark.range(20_000, 40_000).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("j"))
    assert done_keys.marked(others, ["k", "j"], both, bits=bits).where("known").count() < 400
    whole = done_keys.filter_of(a.unionByName(b), ["k", "j"], bits)
    assert {(r.slice, bytes(r.bits)) for r in whole.collect()} == {(r.slice, bytes(r.bits)) for r in both.collect()}
    with pytest.raises(ValueError):
        done_keys.filter_of(a, ["k"], 5000)


@pytest.mark.parametrize("bits", [1 << 12, 1 << 20])  # the smaller one is full
def test_resume_is_exact(spark, bits):
    shared(spark)
    todo = spark.range(0, 4000).select(F.when(F.col("id") % 500 > 0, F.col("id")).alias("k"), F.lit("x").alias("t")).repartition(4)
    done = spark.range(1000, 30_000, 3).select(F.col("id").alias("k"), F.lit(1).alias("more"))
    known = done_keys.filter_of(done, ["k"], bits)
    want = sorted((r.k or -1) for r in todo.join(done.select("k"), "k", "left_anti").collect())
    assert sorted((r.k or -1) for r in done_keys.not_done(todo, done, ["k"], known, bits).collect()) == want
    nulls = done.unionByName(spark.createDataFrame([(None, 1)], "k long, more int"))  # a null key can be done
    got = done_keys.not_done(todo, nulls, ["k"], done_keys.merged(known, done_keys.filter_of(nulls, ["k"], bits)), bits)
    assert got.where("k is null").count() == 0 and got.columns == ["k", "t"]
    nothing = done_keys.filter_of(done.where("false"), ["k"], bits)
    assert done_keys.not_done(todo, done.where("false"), ["k"], nothing, bits).count() == 4000 and done_keys.not_done(todo.where("false"), done, ["k"], known, bits).count() == 0


def test_only_rows_in_question_are_joined(spark):
    shared(spark)
    todo, done = spark.range(99_000, 100_100), spark.range(0, 100_000)
    out = done_keys.not_done(todo, done, ["id"], done_keys.filter_of(done, ["id"]))
    assert out.count() == 100
    picked = done_keys.marked(done, ["id"], done_keys.filter_of(todo, ["id"], 1 << 23), bits=1 << 23).where("known")
    assert 1000 <= picked.count() < 1020  # of a hundred thousand
