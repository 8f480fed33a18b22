"""Tables that grow by batches, each of which is there once and as a whole, or not at all.

A batch's files are written to a folder of their own. Then one small file, the batch's entry, is put under its final name
by a rename that fails if the name is taken; only entries make rows visible. A batch that is written again, by a
retry or by two writers at once, finds its entry and changes nothing; one that was stopped half way has no entry, and
is written anew. ``compacted`` puts an entry that takes the place of all that it was made of, in the same way.

Entries are JSON: {"data": folder, "replaces": [names of entries]}. A rename within one folder is atomic on HDFS and on
local and network file systems; stores without that need a committer of their own in its place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ENTRIES, DATA = "_entries", "data"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _enter(spark: SparkSession, folder: str, name: str, data: str, replaces: list[str]) -> bool:
    """Put an entry; False if there is one of this name."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    final, fs = _fs(spark, f"{folder}/{ENTRIES}/{name}.json")
    draft, _ = _fs(spark, f"{folder}/{ENTRIES}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"data": data, "replaces": sorted(replaces)}).encode()))
    out.close()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        taken = fs.exists(final)
        fs.delete(draft, False)
        if not taken:
            raise
        return False
    return True


def entries(spark: SparkSession, folder: str) -> dict[str, str]:
    """The entries that count, by name, with their data folders; those that a compaction has replaced don't."""
    at, fs = _fs(spark, f"{folder}/{ENTRIES}")
    if not fs.exists(at):
        return {}
    found: dict[str, dict] = {}
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")]
    if names:
        rows = spark.read.text([f"{folder}/{ENTRIES}/{n}" for n in names], wholetext=True).selectExpr("_metadata.file_name AS name", "value").collect()  # one small row a batch
        found = {r["name"].removesuffix(".json"): json.loads(r["value"]) for r in rows}
    gone = {x for e in found.values() for x in e["replaces"]}
    return {n: e["data"] for n, e in sorted(found.items()) if n not in gone}


def has(spark: SparkSession, folder: str, name: str) -> bool:
    path, fs = _fs(spark, f"{folder}/{ENTRIES}/{name}.json")
    return fs.exists(path)


def append(df: DataFrame, folder: str, name: str) -> bool:
    """Write a batch under its name, which tells it from all others; False (and no change) if it is there already."""
    spark = df.sparkSession
    if has(spark, folder, name):
        return False
    data = f"{DATA}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{data}")
    done = _enter(spark, folder, name, data, [])
    if not done:
        path, fs = _fs(spark, f"{folder}/{data}")
        fs.delete(path, True)
    return done


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all entries. A table without any is empty."""
    found = entries(spark, folder)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/{d}" for d in found.values()))


def compacted(spark: SparkSession, folder: str, schema: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> bool:
    """Put all rows there are, changed, into one entry in place of theirs. Batches that come meanwhile stay as they are; False
    if another compaction of one of the same entries came first."""
    found = entries(spark, folder)
    if len(found) < 2:
        return False
    name = f"compacted-{max(found)}"  # two compactions up to one entry take the same name, and one of them fails
    data = f"{DATA}/{name}-{uuid.uuid4().hex}"
    change(spark.read.schema(schema).parquet(*(f"{folder}/{d}" for d in found.values()))).write.parquet(f"{folder}/{data}")
    return _enter(spark, folder, name, data, list(found))


def swept(spark: SparkSession, folder: str) -> int:
    """Delete data folders that no entry names (of stopped or replaced batches) and return their number. Nothing may be
    writing or reading older entries."""
    keep = {d.rpartition("/")[2] for d in entries(spark, folder).values()}
    at, fs = _fs(spark, f"{folder}/{DATA}")
    old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in keep] if fs.exists(at) else []
    for path in old:
        fs.delete(path, True)
    return len(old)
