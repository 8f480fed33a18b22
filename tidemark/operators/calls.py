"""Calls to outside services at a bounded pace: one task for each host or vendor, retries with growing pauses, failures as rows.

All requests of a key (a host, a vendor) go to one task, so its pace holds for the whole cluster; a task has many keys and
takes their requests mixed, so that it seldom waits for one while another is free. A key with very many requests
takes as long as its pace says, on any cluster, and its requests pass one by one; none is held back in memory.

Results are written before they are used (``letters``), since a plan that is run again would call again. A null request isn't sent and has
neither an answer nor an error. Repeated requests are sent each time; a null key is a key of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Call = Callable[[str], str]
RESULT = ("answer", "error", "tries")


def retried(call: Callable, attempts: int, pause: float, wait: Callable[[float], None] = time.sleep):  # noqa: ANN201
    """The call's result; it is tried ``attempts`` times at most, with pauses that double. The last error rises."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n == attempts - 1:
                raise
            wait(pause * 2**n)
    raise ValueError("no attempts")


class Bucket:
    """A token bucket: ``rate`` tokens a second, ``burst`` at most. ``take`` waits for one."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> None:
        if rate <= 0 or burst < 1:
            raise ValueError("a bucket needs a rate and room for a token")
        self.rate, self.burst, self.clock, self.wait = rate, burst, clock, wait
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            pause = (1 - self.tokens) / self.rate
            self.wait(pause)
            self.tokens, self.at = 1.0, now + pause
        self.tokens -= 1


def paced(df: DataFrame, key: Column, request: str, call: Call, rate: float, burst: int = 1, attempts: int = 3, pause: float = 0.5, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """With the columns answer, error (of the last try) and tries. Every try takes a token of the row's key."""
    taken = set(RESULT) & set(df.columns)
    if taken:
        raise ValueError(f"columns have names of results: {', '.join(sorted(taken))}")
    schema = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())])
    rows = df.withColumn("__key", F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")))
    rows = rows.repartition("__key").sortWithinPartitions(F.xxhash64(request, "__key"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[str, Bucket] = {}

        def one(k: str, text: str) -> tuple[str | None, str | None, int]:
            bucket = buckets.setdefault(k, Bucket(rate, burst, clock, wait))
            tries = 0

            def tried() -> str:
                nonlocal tries
                bucket.take()
                tries += 1
                return call(text)

            try:
                return retried(tried, attempts, pause, wait), None, tries
            except Exception as e:  # the service's failures are data here
                return None, f"{type(e).__name__}: {e}", tries

        for b in batches:
            got = [(None, None, 0) if r is None else one(k, r) for k, r in zip(b.column("__key").to_pylist(), b.column(request).to_pylist())]
            answers = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != "__key"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *answers], [*(n for n, _ in kept), *RESULT])

    return rows.mapInArrow(ask, schema)


def letters(answers: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Answered rows and dead letters (those with an error), both from one table that is written to ``path``: each request is sent
    once, or again by a task that was lost."""
    answers.write.parquet(path)
    got = answers.sparkSession.read.schema(answers.schema).parquet(path)
    return got.where("error is null"), got.where("error is not null")
