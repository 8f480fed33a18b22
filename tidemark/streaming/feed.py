"""An append-only review feed as a stream: micro-batches, ids seen before, the best row of each text, late rows.

Ids that were seen are keys of Spark's state store, so a batch costs what its own rows cost, however long the history.
The state's checkpoint and the table are enough to go on after a stop; a batch that is run again writes the same folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import since_or_unread
from ..operators.dedupe import best_by_text, first_by_id
from ..sources.readers import exists


def feed(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 10) -> DataFrame:
    """New files of a folder as a stream, so many in each batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def not_late(df: DataFrame, raw_time: str, as_of: dt.datetime, days: int | None) -> DataFrame:
    return df if days is None else df.where(since_or_unread(F.col(raw_time), as_of, days))


def once(old: DataFrame | None, new: DataFrame, keys: list[str], review_id: str, seq: str) -> DataFrame:
    """The first row of each id among old and new rows."""
    return first_by_id(new if old is None else old.unionByName(new), keys, review_id, [F.col(seq).asc()])


def best(rows: DataFrame, keys: list[str], body: str, time: str, seq: str) -> DataFrame:
    """The best row of each text among rows with distinct ids."""
    return best_by_text(rows, keys[0], body, time, [F.col(seq).asc()]).drop("text_hash")


def _named(review_id: str) -> Column:
    """Whether a row has an id at all; rows without one are never told from one another."""
    return F.coalesce(F.trim(F.col(review_id).cast("string")), F.lit("")) != ""


def fresh(stream: DataFrame, keys: list[str], review_id: str, seq: str) -> DataFrame:
    """A stream's rows with, for each id, what the state store knows: the first row (by ``seq``) as ``row``, and the times of
    the batches in which the id came first (``since``) and last (``at``). An id is new where the two are equal."""
    rows = stream.where(_named(review_id)).select(*keys, review_id, F.struct(*(F.col(c) for c in stream.columns)).alias("row"), F.current_timestamp().alias("at"))
    return rows.groupBy(*keys, review_id).agg(F.min_by("row", F.col(f"row.{seq}")).alias("row"), F.min("at").alias("since"), F.max("at").alias("at")).select("row", "since", "at")


def appended_once(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes the rows with new ids to a folder of the batch, over whatever a failed run has left there."""

    def run(batch: DataFrame, n: int) -> None:
        batch.where("since = at").select("row.*").write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return run


def latest(spark: SparkSession, folder: str, keys: list[str], body: str, time: str, seq: str) -> DataFrame:
    """The reviews as they stand: of the first rows of all ids the best of each text."""
    named = [f"{folder}/named", f"{folder}/unnamed"]
    parts = [spark.read.option("basePath", p).parquet(f"{p}/batch=*").drop("batch") for p in named if exists(spark, f"{p}/batch=*")]
    return best(reduce(DataFrame.unionByName, parts), keys, body, time, seq)


def start(stream: DataFrame, table: str, checkpoint: str, keys: list[str], review_id: str, seq: str) -> list[StreamingQuery]:
    """Run over all files there are, batch by batch, then stop: one query for rows with ids, one for those without. The
    state is kept by RocksDB with a log of changes."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

    def put(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{table}/unnamed/batch={n}")

    every = lambda df, name: df.writeStream.option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True)
    one = every(fresh(stream, keys, review_id, seq), "named").outputMode("update").foreachBatch(appended_once(f"{table}/named")).start()
    two = every(stream.where(~_named(review_id)), "unnamed").foreachBatch(put).start()
    return [one, two]


def finish(queries: list[StreamingQuery]) -> None:
    for q in queries:
        q.awaitTermination()


def start_append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def deduped_within(stream: DataFrame, keys: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """First rows of each key while the watermark remembers it: an extension for unbounded feeds, where rows are never
    replaced by better ones."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts of each time window: an extension."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))
