"""Paced calls: pace for each host, retries, dead letters."""

import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import calls, enrich

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test


class Service:
    """Notes when each request comes, in files, since tasks have objects of their own; some requests fail at first or always."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, text):
        host, n, fails = text.split(" ")
        at = f"{self.folder}/{host}"
        with open(at, "a") as f:
            f.write(f"{time.time()} {text}\n")
        with open(at) as f:
            seen = sum(line.endswith(f" {text}\n") for line in f)
        if seen <= int(fails):
            raise OSError(f"try {seen}")
        return f"answer {n}"


def test_pace_retries_and_dead_letters(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    rows = [(f"h{k % 3}", f"h{k % 3} {k} {2 if k % 5 == 0 else 0}", k) for k in range(18)] + [("h9", "h9 99 9", 99), (None, None, None), ("h0", None, 7)]
    df = spark.createDataFrame(rows, "host string, request string, n long").repartition(6)
    got = calls.paced(df, F.col("host"), "request", Service(tmp_path / "seen"), rate=10, burst=2, attempts=3, pause=0.01)
    good, dead = calls.letters(got, f"file://{tmp_path}/answers")
    assert {r.n: r.answer for r in good.where("request is not null").collect()} == {k: f"answer {k}" for k in range(18)}
    assert {r.n: r.tries for r in good.where("request is not null").collect()} == {k: 3 if k % 5 == 0 else 1 for k in range(18)}
    assert [(r.n, r.error, r.tries) for r in dead.collect()] == [(99, "OSError: try 3", 3)]
    assert [(r.answer, r.tries) for r in good.where("request is null").collect()] == [(None, 0)] * 2
    for host in os.listdir(tmp_path / "seen"):
        at = sorted(float(line.split(" ")[0]) for line in open(tmp_path / "seen" / host))
        assert len(at) <= 2 + (at[-1] - at[0]) * 10 + 3, host  # the burst, what the rate gives meanwhile, and some for a slow disk
    with pytest.raises(ValueError):
        calls.paced(got, F.col("host"), "request", Service(tmp_path), rate=1)


def test_bucket_waits_as_long_as_it_must():
    now, waits = [0.0], []

    def wait(s):
        waits.append(round(s, 6))
        now[0] += s

    b = calls.Bucket(2.0, 3, lambda: now[0], wait)
    for _ in range(5):
        b.take()
    assert waits == [0.5, 0.5]
    now[0] += 10
    for _ in range(4):
        b.take()
    assert waits == [0.5, 0.5, 0.5]  # no more than the burst was saved up
    with pytest.raises(ValueError):
        calls.Bucket(0, 1)


def test_answers_are_tried_again(spark, tmp_path):
    df = spark.createDataFrame([("a 1 2",), ("b 2 5",)], "p string")
    got = {r.p: (r.answer, r.failed) for r in enrich.answered(df, "p", Service(tmp_path), stub="none", attempts=3).collect()}
    assert got == {"a 1 2": ("answer 1", False), "b 2 5": ("none", True)}
