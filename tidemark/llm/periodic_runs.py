"""Runs of periodic words, found by Karp-Miller-Rosenberg names.

Every window of 2**k words gets a name, so that windows of one document are equal if and only if their names are: the
names of level k+1 are the ranks of pairs of names of level k. No hash of words or windows is compared anywhere. A
window that doesn't occur again in its document has no name, which keeps the higher levels short.

A run of period q and at least four periods holds three whole neighbouring cells of the grid 0, q, 2q, ..., all three
equal. So candidates are grid points whose three cells agree by the names of their first and last 2**k words
(2**k <= q < 2**(k+1)); of neighbouring candidates of one period the first is enough. Each is extended to both sides by
the longest common extension of i and i+q: name levels in descending order, the highest one repeatedly. Stretches of a
multiple of a smaller period come out with the same ends, and the smallest period stays.

Documents of a slice lie side by side in one array. A word that occurs less than four times in its document stands in no
such run and has no name, and names of different documents differ, so no window that spans two documents has an equal.

Names of up to 2**LEVELS words are kept: 4 * (LEVELS + 1) bytes a word. Longer extensions repeat the highest level. Memory
is bounded by a slice of texts plus one text; nothing is shuffled, a lost executor's partitions are read again.

Nulls, empty texts and texts without words have no runs and collapse to the empty text. Repeated rows and null ids are
kept row by row, an empty table gives an empty table, and columns that aren't named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import tuned

#: Periods that a run has at least, and words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
LEVELS = 18
#: Grid points looked at together, and characters of the texts of a slice.
POINTS, SLICE = 1 << 20, 2_000_000


def first_names(words: list[list[bytes]]) -> np.ndarray:
    """The name of every word of every document, -1 where it occurs less than LEAST_PERIODS times in its document."""
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64, sum(map(len, words)))
    flat += np.repeat(np.arange(len(words), dtype=np.int64), [len(ws) for ws in words]) * max(1, len(ids))
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    return np.where(count[name] >= LEAST_PERIODS, name, -1).astype(np.int32)


def name_levels(first: np.ndarray, levels: int = LEVELS) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words at every position, as far as windows occur again."""
    out = [first]
    for k in range(levels):
        low, step = out[-1], 1 << k
        at = np.flatnonzero((low[:-step] >= 0) & (low[step:] >= 0)) if len(low) > step else np.zeros(0, np.int64)
        _, name, count = np.unique(low[at].astype(np.int64) << 32 | low[at + step], return_inverse=True, return_counts=True)
        again = count[name] > 1
        if not again.any():
            break
        up = np.full(len(low), -1, np.int32)
        up[at[again]] = name[again]
        out.append(up)
    return out


def candidates(levels: list[np.ndarray], longest: int, full: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Periods and grid points whose three cells agree by their names, the first of each chain of neighbours."""
    n, top = len(levels[0]), len(levels) - 1
    # without names at the next level no window of so many words occurs again, as the first three periods of a run would
    most = longest // LEAST_PERIODS if top == full else min(longest // LEAST_PERIODS, ((2 << top) - 1) // (LEAST_PERIODS - 1))
    periods, points, q = [], [], 1
    while q <= most:
        k = min(q.bit_length() - 1, top)
        end = min(1 << q.bit_length(), most + 1, q + max(1, POINTS * q // max(1, n)))
        qs = np.arange(q, end, dtype=np.int64)
        cells = np.maximum(n // qs - 2, 0)
        qq = np.repeat(qs, cells)
        at = (np.arange(len(qq)) - np.repeat(np.cumsum(cells) - cells, cells)) * qq
        name = levels[k]
        for far in (0, 1):  # a cell's first words, then its last ones
            here = name[at + far * (qq - (1 << k))]
            same = (here >= 0) & (here == name[at + far * (qq - (1 << k)) + qq]) & (here == name[at + far * (qq - (1 << k)) + 2 * qq])
            at, qq = at[same], qq[same]
        if len(at):
            new = np.ones(len(at), bool)
            # where names of the highest level don't cover a cell, candidates may be none, and can't stand for the next one
            new[1:] = (qq[1:] != qq[:-1]) | (at[1:] != at[:-1] + qq[1:]) | (qq[1:] >= 2 << k)
            periods.append(qq[new])
            points.append(at[new])
        q = end
    none = np.zeros(0, np.int64)
    return (np.concatenate(periods), np.concatenate(points)) if periods else (none, none)


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words are equal from i and j (i < j) on or, going back, before them."""
    n, got = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, step = levels[k], 1 << k
        going = np.arange(len(i))
        while len(going):
            a = i[going] - got[going] - step if back else i[going] + got[going]
            b = a + j[going] - i[going]
            inside = (a >= 0) & (b < n)
            a, b, going = a[inside], b[inside], going[inside]
            going = going[(name[a] == name[b]) & (name[a] >= 0)]
            got[going] += step
            if k < len(levels) - 1:  # below the highest level a step can't be taken twice
                break
    return got


def runs_of(words: list[list[bytes]], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, starts counted over all documents together; in the order of start, then period."""
    names = name_levels(first_names(words), levels)
    q, at = candidates(names, max(map(len, words), default=0), levels)
    start = at - common(names, at, at + q, True)
    end = at + q + common(names, at, at + q, False)
    enough = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, end, q = start[enough], end[enough], q[enough]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> str:
    """The words joined by one space, of each run the first period only."""
    if len(start):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words).decode()


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    words = [t.encode().split() if t else [] for t in texts]  # bytes are split at space and 0x09 to 0x0D only
    start, length, period = runs_of(words)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    cut = np.searchsorted(start, first)
    start = start - np.repeat(first[:-1], np.diff(cut))
    texts_ = [collapsed(w, start[a:b], length[a:b], period[a:b]) for w, a, b in zip(words, cut, cut[1:])]
    found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUNS.value_type))
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), found, type=RUNS), pa.array(texts_, pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, runs (start, length, period; by start, then period), collapsed (its text without what repeats)."""
    tuned(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column("text").to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                    size += len(texts[end] or "")
                    end += 1
                yield pa.RecordBatch.from_arrays([b.column("id")[at:end], *_found(texts[at:end])], ["id", "runs", "collapsed"])
                at = end

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(found, "id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, in which every tenth document (by the CRC of its id) repeats itself from one of its words on.

    With h the CRC of the decimal id, g = h div 10 and n words: if h is divisible by ten and n > 0, each word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id has no CRC and changes nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    h = F.crc32(F.col("id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # arrays of words are made for the tenth only: what `when` doesn't choose isn't evaluated
    chosen = F.when(h % 10 == 0, words)
    rows = rows.select("id", "text", F.floor(h / 10).alias("g"), chosen.alias("w")).withColumn("n", F.size("w").cast("long"))
    a = F.col("g") % F.col("n")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a))
    p = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    changed = "concat_ws(' ', transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])))"
    return rows.withColumn("p", p).select("id", F.when(F.col("n") > 0, F.expr(changed)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of each document's runs the number, that of the greatest exact exponent, and digests of the runs and of the collapsed text."""
    more = "r.length * coalesce(best.period, 0) > coalesce(best.length, -1) * r.period"
    best = F.expr(f"aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (best, r) -> if(best is null or {more}, r, best))")
    line = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
