"""The reviews of a feed as they stand: ids are taken once, and of each text the best row is known at any time.

State is keyed by hash buckets, so that an app with a third of all reviews is many groups. One operator holds the ids that
were seen, as 16-byte digests without values; the next one holds, for each text, the rank of its best row (its time,
its length if undated, its number), not the row. A batch hands on only rows that are new or better than what stood, and
costs what its own rows cost, however long the history.

What a batch hands on is appended under the batch's number (``committed``), so a batch that is run again is there once.
Readers take the best row of each text among what was handed on; ``compact`` drops the rows that no longer stand.

A row without an id is never taken for another by its id. A null time is undated, a null body or title reads as the
empty text. Equal rows by time or length: the one with the least number stays, whichever batch it comes in; the rank of a
standing row is compared as a whole, so the result doesn't depend on how rows are dealt into batches, but for rows of one
id: there the first batch counts, and in a batch the least number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import review_hash, text_or_blank
from ..sources import committed

#: Groups of the state; as many for a checkpoint's whole life.
BUCKETS = 256
_MARKS = ("mark_bucket", "mark_id", "mark_text", "mark_dated", "mark_at", "mark_size", "mark_seq")


def _least(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """The rows of a group in this batch, in the order of their numbers."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class FirstOfId(StatefulProcessor):
    """Lets the first row of each id pass, and all rows without one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id binary", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = _least(rows, "mark_seq")
        named = got["mark_id"].notna()
        first = ~named | ~got["mark_id"].duplicated()
        for i in got.index[named & first]:
            at = (bytes(got.at[i, "mark_id"]),)
            if self.seen.containsKey(at):
                first[i] = False
            else:
                self.seen.updateValue(at, (int(got.at[i, "mark_seq"]),))
        yield got[first]

    def close(self) -> None:
        pass


class BestOfText(StatefulProcessor):
    """Lets a row pass if it ranks above all rows of its text that passed before, and of a batch only the best."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getMapState("best", "text binary", "dated int, at long, size int, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows), ignore_index=True)
        got = got.sort_values(["mark_dated", "mark_at", "mark_size", "mark_seq"], ascending=[False, False, False, True], ignore_index=True)
        best = ~got["mark_text"].duplicated()
        for i in got.index[best]:
            at = (bytes(got.at[i, "mark_text"]),)
            rank = tuple(int(got.at[i, c]) for c in _MARKS[3:])
            old = self.best.getValue(at)
            if old is not None and (*old[:3], -old[3]) >= (*rank[:3], -rank[3]):
                best[i] = False
            else:
                self.best.updateValue(at, rank)
        yield got[best]

    def close(self) -> None:
        pass


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def marked(rows: DataFrame, key: str, review_id: str, title: str | None, body: str, at: str, seq: str) -> DataFrame:
    """Rows with the digests and the rank that the state knows them by."""
    named = F.coalesce(F.trim(F.col(review_id).cast("string")), F.lit("")) != ""
    text = F.concat_ws(" ", text_or_blank(F.col(title)), text_or_blank(F.col(body))) if title else F.col(body)
    undated = F.col(at).isNull()
    return rows.withColumns({
        "mark_id": F.when(named, F.unhex(F.md5(F.concat_ws("|", text_or_blank(F.col(key).cast("string")), F.col(review_id).cast("string"))))),
        "mark_text": F.unhex(review_hash(F.col(key).cast("string"), text)),
        "mark_dated": (~undated).cast("int"), "mark_at": F.coalesce(F.unix_micros(F.col(at)), F.lit(0)),
        "mark_size": F.when(undated, F.length(text_or_blank(F.col(body)))).otherwise(0), "mark_seq": F.col(seq).cast("long"),
    })


def standing_changes(stream: DataFrame, key: str, review_id: str, body: str, at: str, seq: str, title: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of the rows that stand as they come: each replaces what stood for its text before."""
    rows = marked(stream, key, review_id, title, body, at, seq)
    # rows without an id are spread by their text
    rows = rows.withColumn("mark_bucket", _bucket(F.coalesce("mark_id", "mark_text"), buckets))
    first = rows.groupBy("mark_bucket").transformWithStateInPandas(FirstOfId(), rows.schema, "Append", "None")
    rows = first.withColumn("mark_bucket", _bucket(F.col("mark_text"), buckets))
    return rows.groupBy("mark_bucket").transformWithStateInPandas(BestOfText(), rows.schema, "Append", "None").drop("mark_bucket", "mark_id")


def start(changes: DataFrame, table: str, checkpoint: str, many: bool = True) -> StreamingQuery:
    """Append what changes, batch by batch, over all input there is. The state is kept by RocksDB with a log of changes; with
    ``many`` batches to come it stays open between them, else executors close it after each one and need no disk for it."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

    def put(batch: DataFrame, n: int) -> None:
        if not committed.append(batch, table, f"{n:010d}"):
            batch.write.format("noop").mode("overwrite").save()  # the state still has to see a batch that is run again

    closing = "spark.sql.streaming.stateStore.unloadOnCommit"
    before = spark.conf.get(closing, "false")
    spark.conf.set(closing, str(not many).lower())
    try:
        return changes.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.set(closing, before)  # a query keeps the settings that it was started with


def _best(rows: DataFrame) -> DataFrame:
    order = F.struct("mark_dated", "mark_at", "mark_size", (-F.col("mark_seq")).alias("s"))
    whole = F.struct(*rows.columns)
    return rows.groupBy("mark_text").agg(F.max_by(whole, order).alias("row")).select("row.*")


def standing(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows that stand, with the columns of ``schema`` (that of ``standing_changes``) but the state's own."""
    return _best(committed.read(spark, table, schema)).drop(*_MARKS)


def compact(spark: SparkSession, table: str, schema: str) -> bool:
    """Rewrite the table to the rows that stand."""
    return committed.compacted(spark, table, schema, _best)
