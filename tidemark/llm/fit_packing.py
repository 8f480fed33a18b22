"""Packing of tokenized documents into as few sequences as it can: dominance reduction, then best fit.

Lengths are whole numbers up to ``limit``, so what the packing depends on is one count for each length, which is all that
the driver sees: at most ``limit`` numbers, whatever the size of the corpus.

1. Reduction (Martello and Toth). For a longest piece left, a set that holds it *dominates* if in any other feasible set
   with that piece the rest can be exchanged for what the dominating set has, without needing more room elsewhere. Let j*
   be the longest other piece that fits beside it. Fixed are: the piece alone, if nothing fits; the piece and j*, if they
   fill the sequence, if no two others fit, or if no three do and j* is as long as the best two; the piece and the best two,
   if no three fit, j* is one of these and no two pieces longer than the smaller of them fit. What is fixed is taken out,
   as often as the lengths last, and the rest is reduced again until nothing changes. Some best packing has all these sets.
2. Best fit, longest first, packs the rest: each piece goes to the sequence with the least room that takes it. Sequences
   with the same content are one pattern with a number of times.
3. Each length's pieces are numbered in Spark (within hash buckets, offset by counts, so no length meets in one task), and a
   piece finds its sequence and place by its number in the plan of patterns. Texts and tokens aren't shuffled.

A text is encoded once, where it is read. Memory is bounded by a slice of texts, the codec's memo and one text. Pieces are
written before they are counted, so an executor that is lost repeats its tasks with the same numbers.

Nulls and empty texts are the end token alone. Repeated rows and null ids are packed row by row; an empty table gives an
empty table; other columns aren't read, so clashing names don't matter.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ranked_within, slices, tuned, written
from .bpe_codec import Codec

LIMIT, END = 4096, 1


#: Signs other than the apostrophe and the angle brackets of special tokens.
SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Words that are remembered with their ids, in each of two generations.
WORDS = 200_000


class Words(dict):
    """The ids of words between white space, as little-endian 32-bit numbers; a word that isn't there yet is encoded.

    Where a tokenizer's own rules keep such words apart (``parts_words``), they part a run of letters from the run of signs
    after it, too. For Latin letters these rules are few: each letter is composed, has one small form and is written as
    the signs that the library itself gives for it, so the library's model is asked for such pieces directly. All other words
    go through the whole library.
    """

    def __init__(self, ids: Ids, older: dict[bytes, bytes]) -> None:
        super().__init__()
        self.tokenize, self.ids, self.older = ids.lib.model.tokenize, ids, older
        self.signs: dict[bytes, bytes] = {}

    def piece(self, text: str) -> bytes:
        ids = [t.id for t in self.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        out = self.older.get(word)
        if out is None:
            core = word.rstrip(SIGNS)
            if core.isalpha():  # ASCII letters
                small = core.lower()
                out = self.get(small) or self.piece(small.decode())
            elif core and LATIN(text := core.decode("utf-8", "surrogatepass")):
                out = self.piece(text.lower().translate(self.ids.written))
            else:
                core, out = word, self.ids.whole(word.decode("utf-8", "surrogatepass"))
            if len(core) < len(word):
                signs = word[len(core) :]
                more = self.signs.get(signs)
                if more is None:
                    more = self.signs[signs] = self.piece(signs.decode())
                out += more
        self[word] = out
        return out


class Ids:
    """A tokenizer that gives ids as little-endian 32-bit numbers, with a bounded memory of words."""

    def __init__(self, path: str) -> None:
        self.codec = Codec(path)
        self.lib = self.codec.lib
        letters = [chr(c) for c in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))]
        self.written = str.maketrans({x: "".join(piece for piece, _ in self.lib.pre_tokenizer.pre_tokenize_str(x)) for x in letters}) if self.codec.parts else {}
        self.forget()

    def forget(self) -> None:
        """Drop all that is remembered."""
        self.words = Words(self, {})

    def whole(self, text: str) -> bytes:
        ids = self.codec.whole(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        if not self.codec.parts:
            return [self.whole(t or "") for t in texts]
        if len(self.words) > WORDS:  # what comes again moves on from the older generation
            older, self.words.older = self.words, {}
            self.words = Words(self, older)
        ids = self.words.__getitem__
        return [b"".join(map(ids, t.encode("utf-8", "surrogatepass").split())) if t else b"" for t in texts]


@cache
def codec(path: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


class _Lengths:
    """A multiset of lengths."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def without(self, size: int) -> dict[int, int]:
        """The counts with one piece of this length less."""
        return {size: self.count[size] - 1}

    def least(self, n: int, less: dict[int, int], above: int = 0) -> list[int]:
        """The ``n`` smallest pieces longer than ``above``, as far as there are."""
        out: list[int] = []
        for s in self.sizes[bisect_right(self.sizes, above) :]:
            out += [s] * min(n - len(out), less.get(s, self.count[s]))
            if len(out) == n:
                break
        return out

    def largest(self, room: int, less: dict[int, int]) -> int:
        """The longest piece that fits, or 0."""
        i = bisect_right(self.sizes, room) - 1
        while i >= 0 and not less.get(self.sizes[i], self.count[self.sizes[i]]):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def best_two(self, room: int, less: dict[int, int]) -> tuple[int, int]:
        """The two pieces, longest first, with the greatest sum that fits; of equal sums that with the longest piece."""
        sizes = [s for s in self.sizes if less.get(s, self.count[s])]
        best, lo, hi = (0, 0, 0), 0, len(sizes) - 1
        while lo <= hi:
            a, b = sizes[hi], sizes[lo]
            if a + b > room or (lo == hi and less.get(a, self.count[a]) < 2):
                hi -= 1
            else:
                best = max(best, (a + b, a, b))
                lo += 1
        return best[1], best[2]


def dominating(have: _Lengths, j: int, limit: int) -> tuple[int, ...] | None:
    """A set with a piece of length j that dominates all others with it, by the rules above; None if they don't tell."""
    less, room = have.without(j), limit - j
    partner = have.largest(room, less)
    if not partner:
        return (j,)
    least = have.least(3, less)
    if partner == room or sum(least[:2]) > room or len(least) < 2:
        return j, partner
    if len(least) == 3 and sum(least) <= room:
        return None
    a, b = have.best_two(room, less)
    if partner >= a + b:
        return j, partner
    if a == partner:
        longer = have.least(2, less | {a: less.get(a, have.count[a]) - 1}, above=b)
        if len(longer) < 2 or sum(longer) > room:
            return j, a, b
    return None


#: A pattern: how many sequences have it, and the (length, how many) in it, in order.
Pattern = tuple[int, list[tuple[int, int]]]


def reduced(counts: dict[int, int], limit: int = LIMIT) -> tuple[list[Pattern], dict[int, int]]:
    """The patterns that are fixed, and the counts of what is left."""
    have, out, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for j in sorted(have.sizes, reverse=True):
            while j in have.count and (got := dominating(have, j, limit)) is not None:
                # taking pieces away keeps every rule true while the set's own lengths last
                times = min(have.count[s] // got.count(s) for s in set(got))
                for s in set(got):
                    have.take(s, times * got.count(s))
                out.append((times, [(s, got.count(s)) for s in dict.fromkeys(got)]))
                changed = True
    return out, have.count


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> list[Pattern]:
    """Best fit, longest first, of lengths with counts."""
    open_: dict[int, list[Pattern]] = {}  # by room
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(room: int, pattern: Pattern) -> None:
        if not room:
            done.append(pattern)
        elif room in open_:
            open_[room].append(pattern)
        else:
            open_[room] = [pattern]
            insort(rooms, room)

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                times, content = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:  # new sequences, as many as are needed
                room, times, content = limit, -(-n // (limit // size)), []
            each = room // size  # a sequence takes pieces of one length until it has no room for another
            full = min(times, n // each)
            if full:
                put(room - each * size, (full, [*content, (size, each)]))
                n -= full * each
                times -= full
            if times and 0 < n < each:
                put(room - n * size, (1, [*content, (size, n)]))
                times, n = times - 1, 0
            if times:
                put(room, (times, content))
    return done + [p for r in rooms for p in open_[r]]


def packing(counts: dict[int, int], limit: int = LIMIT) -> list[Pattern]:
    if any(not 0 < s <= limit for s in counts):
        raise ValueError(f"lengths must be from 1 to {limit}")
    fixed, rest = reduced(counts, limit)
    return fixed + best_fit(rest, limit)


class Plan:
    """For each length the stretches of its pieces' numbers, with the first sequence and the place that a stretch goes to."""

    def __init__(self, patterns: list[Pattern]) -> None:
        used: dict[int, int] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0
        for times, content in patterns:
            offset = 0
            for size, each in content:
                at = used.get(size, 0)
                rows.setdefault(size, []).append((at, self.sequences, each, offset))
                used[size] = at + times * each
                offset += size * each
            self.sequences += times
        self.rows = {s: np.array(r, np.int64) for s, r in rows.items()}

    def place(self, size: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces of one length by their numbers (from 0)."""
        rows = self.rows[size]
        at, first, each, offset = rows[np.searchsorted(rows[:, 0], number, side="right") - 1].T
        which, nth = np.divmod(number - at, each)
        return first + which, offset + nth * size


def packed(pieces: DataFrame, length: str = "length", limit: int = LIMIT, name: str = "pieces") -> DataFrame:
    """A table of pieces with the sequence that each is in (``sequence_id``) and its place there (``offset``). ``length`` is never null."""
    spark = pieces.sparkSession
    pieces = written(pieces, name)
    counts = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``limit`` rows
    plan = spark.sparkContext.broadcast(Plan(packing(counts, limit)))
    numbered = pieces.withColumn("__h", F.xxhash64(*(F.col(f"`{c}`") for c in pieces.columns)))
    numbered = ranked_within(numbered, length, "__h", [], "__rank", "__total").drop("__h", "__total")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            sizes, ranks = b.column(length).to_numpy(), b.column("__rank").to_numpy() - 1
            order = np.argsort(sizes, kind="stable")
            cut = np.flatnonzero(np.diff(sizes[order])) + 1
            for rows in np.split(order, cut) if len(b) else []:
                sequence[rows], offset[rows] = plan.value.place(int(sizes[rows[0]]), ranks[rows])
            kept = [x for x, name in zip(b.columns, b.schema.names) if name != "__rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*(n for n in b.schema.names if n != "__rank"), "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return numbered.select(*pieces.columns, "__rank").mapInArrow(placed, f"{fields}, sequence_id long, offset long")


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and with ``ids`` the tokens themselves."""
    tuned(docs.sparkSession)
    last = np.array([END], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        try:
            for f in slices(frames, "text", 500_000):
                rows = []
                for i, raw in zip(f["id"], c.ids_of(f["text"].tolist())):
                    raw += last
                    for at in range(0, len(raw), 4 * limit):
                        part = raw[at : at + 4 * limit]
                        rows.append((i, at // 4 // limit, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if ids else [])))
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])
        finally:  # a worker is reused for other stages
            c.forget()

    # pandas makes floats of whole numbers with nulls, so ids pass as texts
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    got = rows.mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else ""))
    return got.withColumn("id", F.col("id").cast("long"))


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(pieces_of(docs, path, id_col, text_col, limit), "length", limit)


def sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The sequences themselves: sequence_id, ids (at most ``limit``), and the pieces in them in order. Here tokens are shuffled, to
    groups of at most ``limit`` tokens."""
    rows = packed(pieces_of(docs, path, id_col, text_col, limit, ids=True), "length", limit)
    own = F.sort_array(F.collect_list(F.struct("offset", "id", "piece", "start", "length", "ids")))
    got = rows.groupBy("sequence_id").agg(own.alias("own"))
    return got.select("sequence_id", F.expr("flatten(own.ids)").alias("ids"), F.expr("transform(own, x -> named_struct('id', x.id, 'piece', x.piece, 'offset', x.offset, 'length', x.length))").alias("pieces"))
