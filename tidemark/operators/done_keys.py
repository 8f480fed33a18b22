"""Resuming against a very large table of done keys without shuffling it: stored Bloom filters that can be merged.

A filter is a table of slices of bits, as large for any number of keys (``bits``; ten for each key make one in a hundred
unknown keys look known). It is built in tasks, slices are joined by "or", and filters of more done keys are merged in
the same way, so it is kept beside the done table and only grows by what is new.

``not_done`` is exact whatever the filters say. A row that the done filter doesn't know is new, and isn't compared. What it
may know makes a filter of its own, by which the done table's rows are picked where they are read; only these and the
rows in question are shuffled. So the bytes that move follow the todo list, not the done table. Both filters reach the
tasks as a broadcast of ``bits`` / 8 bytes, a parameter.

Nulls are keys like others here, as the null-safe comparison of the anti join takes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, SLICES, HASHES = 1 << 25, 64, 5
SCHEMA = "slice int, bits binary"


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*(x for k in keys for x in (F.col(k).isNull(), F.col(k))))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES places for each 64-bit hash."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1)


def _sliced(words: np.ndarray) -> pd.DataFrame:
    parts = words.reshape(SLICES, -1)
    some = np.flatnonzero(parts.any(axis=1))
    return pd.DataFrame({"slice": some.astype(np.int32), "bits": [parts[i].tobytes() for i in some]})


def filter_of(df: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """The filter of a table's keys. ``bits`` is a power of two, 4,096 at least, and the same for all filters that are merged."""
    if bits < 4096 or bits & (bits - 1):
        raise ValueError("bits must be a power of two from 4,096 on")

    def built(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros(bits // 8, np.uint8)
        for f in frames:
            at = _places(f["h"].to_numpy(np.int64).view(np.uint64), bits).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield _sliced(words)

    return merged(df.select(_hash(keys).alias("h")).mapInPandas(built, SCHEMA))


def merged(*filters: DataFrame) -> DataFrame:
    """One filter that knows what any of them does."""
    rows = filters[0]
    for f in filters[1:]:
        rows = rows.unionByName(f)

    def either(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, np.ndarray] = {}
        for f in frames:
            for i, b in zip(f["slice"], f["bits"]):
                x = np.frombuffer(b, np.uint8)
                out[i] = out[i] | x if i in out else x
        yield pd.DataFrame({"slice": np.array(list(out), np.int32), "bits": [x.tobytes() for x in out.values()]})

    return rows.repartition(SLICES, "slice").mapInPandas(either, SCHEMA)


def _broadcast(known: DataFrame, bits: int) -> Broadcast:
    words = np.zeros((SLICES, bits // 8 // SLICES), np.uint8)
    for r in known.collect():  # SLICES rows, whatever the number of keys
        words[r["slice"]] |= np.frombuffer(r["bits"], np.uint8)
    return known.sparkSession.sparkContext.broadcast(words.ravel())


def marked(df: DataFrame, keys: list[str], known: DataFrame, name: str = "known", bits: int = BITS) -> DataFrame:
    """With a column that is false where the filter has never seen the row's key."""
    words = _broadcast(known, bits)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column("__h").to_numpy(zero_copy_only=False).view(np.uint64), bits)
            seen = (words.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != "__h"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(seen.all(axis=1))], [*(n for n, _ in kept), name])

    return df.withColumn("__h", _hash(keys)).mapInArrow(look, schema)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str], known: DataFrame, bits: int = BITS, own_bits: int = 1 << 23) -> DataFrame:
    """The rows of ``todo`` whose keys aren't in ``done``; ``known`` is the done table's filter, or one of a larger table. Needs a
    checkpoint folder: the marked rows are written, since they are read twice."""
    rows = marked(todo, keys, known, "__known", bits).checkpoint()
    doubtful = rows.where("__known").drop("__known")
    picked = marked(done.select(*keys), keys, filter_of(doubtful, keys, own_bits), "__asked", own_bits).where("__asked")
    same = [F.col(f"t.`{k}`").eqNullSafe(F.col(f"d.`{k}`")) for k in keys]
    new = doubtful.alias("t").join(picked.alias("d"), same, "left_anti")
    return rows.where("not __known").drop("__known").unionByName(new)
