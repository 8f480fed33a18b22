"""How the sources of a language differ in their terms, by mergeable radix tries.

1. Every task counts the terms of its documents and bulk-loads them, sorted, into a radix trie over UTF-8 bytes for each
   language: a leaf holds the number of documents with its term and a counter per source. Tries are written in linear form,
   each leaf with the depth at which it leaves the path of the one before, cut into prefix ranges (``WIDTH`` bytes; a range
   of more than ``LEAVES`` leaves is cut at longer prefixes), once a task holds ``HELD`` counters, so that memory doesn't
   grow with the task.
2. The tries of each prefix range are merged in one task, each along a cursor from the root that goes no further up than
   the depth of the next leaf. Leaves of terms in fewer than ``least_docs`` documents of the language are dropped. The
   merged tries are written; sums of their counters give each group's totals.
3. Each merged trie is walked in the order of its bytes, which is that of UTF-8. The walk adds up the differences of all
   pairs of sources and keeps, per group, the best ``ranks`` terms; of equal ones the first in that order stay. Each task
   hands on these sums and candidates, which Spark adds and ranks.

With c occurrences, a group's N over all V kept terms of its language has p = 1 + floor(SCALE * (c + 5) / (N + 5 V)), all in
whole numbers. Terms that two sources don't have differ by a constant, so sums over them take one multiplication: a task
looks only at the counters that there are.

Pairs of sources are as many as the result's rows. No key meets in one task: a range has one trie for each task that
counted, whatever the number of its occurrences. An executor that is lost repeats its tasks from written tables.

A null text, language or source reads as the empty string. Repeated rows and null ids count row by row; an empty table gives
an empty table; other columns aren't read, so clashing names don't matter. Totals and scaled sums must stay below 2**63:
N + 5 V up to 9 * 10**15 is exact, more is refused.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import discard, partitions, sized_join, tuned, written

SCALE, SMOOTH = 1_000_000_000, 5
LEAST_DOCS, RANKS = 30, 50
#: Bytes of a prefix, counters held by a task, leaves of a range (over all tasks) beyond which its prefix gets longer, leaves
#: of a row; bytes at a term's beginning that are compared for all terms at once.
HEAD = 24
WIDTH, HELD, LEAVES, ROW = 2, 400_000, 500_000, 2_000
#: A-Z are lower-cased; ASCII other than letters ends a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM).split() if text else []


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each in the narrowest type that holds it."""
    out = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        out += [struct.pack("<BI", kind.itemsize, len(x)), x.astype(f"<u{kind.itemsize}").tobytes()]
    return b"".join(out)


def _unpacked(raw: bytes, n: int) -> tuple[list[list[int]], int]:
    """``n`` arrays, and where they end."""
    out, at = [], 0
    for _ in range(n):
        width, size = struct.unpack_from("<BI", raw, at)
        at += 5
        out.append(np.frombuffer(raw, f"<u{width}", size, at).tolist())
        at += width * size
    return out, at


def _depths(words: list[bytes]) -> np.ndarray:
    """For each of some sorted, different terms how many bytes it shares with the one before (0 for the first)."""
    out = np.zeros(len(words), np.int64)
    if len(words) > 1:
        heads = np.array(words, f"S{HEAD}").view(np.uint8).reshape(len(words), HEAD)  # no term holds a zero byte
        other = heads[1:] != heads[:-1]
        out[1:] = other.argmax(axis=1)
        for i in np.flatnonzero(~other.any(axis=1)) + 1:
            out[i] = _shared(words[i - 1], words[i])
    return out


def _coded(words: list[bytes], depth: np.ndarray, docs: np.ndarray, first: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> bytes:
    """The linear form of a trie of sorted terms; the counters of term i are those from first[i] to first[i + 1]. Of the depths
    the first is taken for 0."""
    depth = depth.copy()
    depth[:1] = 0
    ends = [w[d:] for w, d in zip(words, depth.tolist())]
    return _packed(depth, np.array(list(map(len, ends)), np.int64), docs, np.diff(first), sources, counts) + b"".join(ends)


def leaves_of(nodes: bytes, names: list[str]) -> Iterator[tuple[int, bytes, int, dict[str, int]]]:
    """Of each leaf the depth at which its path leaves the one before, the rest of its term, its documents and counters."""
    (depth, sizes, docs, holders, sources, counts), at = _unpacked(nodes, 6)
    i = 0
    for d, size, n, k in zip(depth, sizes, docs, holders):
        yield d, nodes[at : at + size], n, {names[s]: c for s, c in zip(sources[i : i + k], counts[i : i + k])}
        at += size
        i += k


def walk(nodes: bytes, names: list[str]) -> Iterator[tuple[bytes, int, dict[str, int]]]:
    """Terms in the order of their bytes, with documents and counters."""
    term = b""
    for d, rest, n, own in leaves_of(nodes, names):
        term = term[:d] + rest
        yield term, n, own


def dumped(leaves: list[tuple[bytes, int, dict[str, int]]]) -> tuple[bytes, list[str], int]:
    """The linear form of sorted leaves, the sources and the number of leaves."""
    names: dict[str, int] = {}
    holders = [len(own) for _, _, own in leaves]
    sources = np.array([names.setdefault(s, len(names)) for _, _, own in leaves for s in own], np.int64)
    counts = np.array([c for _, _, own in leaves for c in own.values()], np.int64)
    first = np.concatenate([[0], np.cumsum(holders, dtype=np.int64)])
    words = [w for w, _, _ in leaves]
    return _coded(words, _depths(words), np.array([n for _, n, _ in leaves], np.int64), first, sources, counts), list(names), len(leaves)


def _by_prefix(depth: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ROW sorted terms that share their first ``width`` bytes, by their depths."""
    cuts = [*np.flatnonzero(depth < width).tolist(), len(depth)]
    for a, b in zip(cuts, cuts[1:]):
        for at in range(a, b, ROW):
            yield at, min(b, at + ROW)


class Trie:
    """A node of a radix trie: the bytes that lead to it, its children by first byte, and, if a term ends here, the number of
    its documents and its count for each source."""

    __slots__ = ("label", "children", "docs", "counts")

    def __init__(self, label: bytes = b"", docs: int = 0, counts: dict[str, int] | None = None) -> None:
        self.label, self.docs, self.counts = label, docs, counts
        self.children: dict[int, Trie] | None = None  # most nodes are leaves without any

    def merge(self, nodes: bytes, names: list[str]) -> None:
        """Add a trie in linear form. The cursor holds the nodes from the root to the last leaf, with the depths at which they end."""
        cursor, term = [(0, self)], b""
        for shared, rest, docs, counts in leaves_of(nodes, names):
            while cursor[-1][0] > shared:
                cursor.pop()
            term = term[:shared] + rest
            at, node = cursor[-1]
            while at < len(term):
                if node.children is None:
                    node.children = {}
                old = node.children.get(term[at])
                if old is None:
                    new = node.children[term[at]] = Trie(term[at:])
                    at, node = len(term), new
                else:
                    m = len(old.label)
                    if term[at : at + m] != old.label:  # part the edge
                        m = _shared(old.label, term[at : at + m])
                        middle = node.children[term[at]] = Trie(old.label[:m])
                        old.label = old.label[m:]
                        middle.children = {old.label[0]: old}
                        old = middle
                    at, node = at + m, old
                cursor.append((at, node))
            if node.counts is None:
                node.docs, node.counts = docs, counts
            else:
                node.docs += docs
                for s, c in counts.items():
                    node.counts[s] = node.counts.get(s, 0) + c

    def walk(self) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        """Terms in the order of their bytes, with documents and counters."""
        todo = [(b"", self)]
        while todo:
            path, node = todo.pop()
            path += node.label
            if node.counts:
                yield path, node.docs, node.counts
            if node.children:
                todo += [(path, node.children[b]) for b in sorted(node.children, reverse=True)]


def _shared(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # the prefixes of length lo agree, those of length hi don't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


TRIES = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("nodes", pa.binary()), ("names", pa.list_(pa.string())), ("leaves", pa.int64())])
_DDL = "lang string, prefix binary, nodes binary, names array<string>, leaves bigint"


def _rows(rows: list[tuple], schema: pa.Schema = TRIES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema.names)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _rows(held, schema)
            held = []
    if held:
        yield _rows(held, schema)


def counted_tries(docs: DataFrame, width: int = WIDTH, held: int = HELD) -> DataFrame:
    """Tries of (lang, source, text) rows, cut into prefix ranges, as every task counts them."""

    def grown(counts: dict[str, dict[str, Counter]], docs_of: dict[str, Counter]) -> Iterator[tuple]:
        for lang, own in docs_of.items():
            words = sorted(own)
            number = dict(zip(words, range(len(words))))
            names = list(counts[lang])
            leaf = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for c in counts[lang].values()])
            source = np.repeat(np.arange(len(names)), [len(c) for c in counts[lang].values()])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts[lang].values()])
            order = np.argsort(leaf, kind="stable")
            leaf, source, count = leaf[order], source[order], count[order]
            docs = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
            depth = _depths(words)
            for a, b in _by_prefix(depth, width):
                first = np.searchsorted(leaf, np.arange(a, b + 1))
                x, y = first[0], first[-1]
                yield lang, words[a][:width], _coded(words[a:b], depth[a:b], docs[a:b], first - x, source[x:y], count[x:y]), names, b - a

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = {}
        docs_of: dict[str, Counter] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = terms(text.as_py())
                own = counts.setdefault(lang, {}).setdefault(source, Counter())
                size -= len(own)
                own.update(words)
                size += len(own)
                docs_of.setdefault(lang, Counter()).update(set(words))
                if size > held:
                    yield from _batched(grown(counts, docs_of), TRIES)
                    counts, docs_of, size = {}, {}, 0
        yield from _batched(grown(counts, docs_of), TRIES)

    return docs.mapInArrow(counted, _DDL)


def merged_tries(tries: DataFrame, least_docs: int, width: int = WIDTH, leaves: int = LEAVES) -> DataFrame:
    """The tries of each language and prefix range as one, with the terms that enough documents have."""
    # a range with many leaves gets a prefix longer by one byte for each factor of eight
    sizes = tries.groupBy("lang", "prefix").agg(F.sum("leaves").alias("n")).where(F.col("n") > leaves)
    deep = written(sizes.select("lang", "prefix", (F.lit(width) + F.ceil(F.log2(F.col("n") / leaves) / 3)).cast("int").alias("width")), "deep_ranges")

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(row: dict) -> Iterator[tuple]:
            own = list(walk(row["nodes"], row["names"]))
            for a, b in _by_prefix(_depths([w for w, _, _ in own]), row["width"]):
                yield (row["lang"], own[a][0][: row["width"]], *dumped(own[a:b]))

        for b in batches:
            yield from _batched((x for row in b.to_pylist() for x in cut(row)), TRIES)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(key: tuple, trie: Trie) -> Iterator[tuple]:
            own = [leaf for leaf in trie.walk() if leaf[1] >= least_docs]
            for at in range(0, len(own), ROW):
                yield (*key, *dumped(own[at : at + ROW]))

        def streamed() -> Iterator[tuple]:
            key, trie = None, Trie()
            for b in batches:
                for r in b.to_pylist():
                    if (r["lang"], r["prefix"]) != key:
                        if key is not None:
                            yield from kept(key, trie)
                        key, trie = (r["lang"], r["prefix"]), Trie()
                    trie.merge(r["nodes"], r["names"])
            if key is not None:
                yield from kept(key, trie)

        yield from _batched(streamed(), TRIES, 50)

    if not deep.isEmpty():
        heavy = sized_join(tries, deep, ["lang", "prefix"]).select(*TRIES.names, "width").mapInArrow(recut, _DDL)
        tries = sized_join(tries, deep, ["lang", "prefix"], "left_anti").unionByName(heavy)
    n = partitions(tries.sparkSession)
    return tries.repartitionByRange(n, "lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(merged, _DDL)


def probabilities(c: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (c + SMOOTH) / total), exactly: a long division in steps of a thousand."""
    q, r = np.divmod(c + SMOOTH, total)
    step = 1000
    for _ in range(3):  # SCALE is 1000 ** 3
        more, r = np.divmod(r * step, total)
        q = q * step + more
    return q + 1


PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class Differences:
    """What one task adds up for one language: differences of its sources, and each source's best terms so far."""

    def __init__(self, names: list[str], totals: list[int], kept: int, ranks: int) -> None:
        self.at = {s: i for i, s in enumerate(names)}
        self.names, self.ranks = names, ranks
        n = np.array(totals, np.int64)
        if max(totals, default=0) + SMOOTH * kept > 9 * 10**15 or int(n.sum()) + SMOOTH * kept > 9 * 10**15:
            raise ValueError("a language has too many occurrences for exact 64-bit numbers")
        self.below = n + SMOOTH * kept
        self.whole = n.sum() + SMOOTH * kept
        self.none = probabilities(np.zeros(len(n), np.int64), self.below)  # of a term that a source doesn't have
        self.pairs = np.zeros((len(n), len(n)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in names]

    def add(self, leaves: list[tuple[bytes, dict[str, int]]]) -> None:
        """Leaves in the order of their terms, a bounded number of them."""
        c = np.zeros((len(leaves), len(self.names)), np.int64)
        for i, (_, counts) in enumerate(leaves):
            for s, n in counts.items():
                c[i, self.at[s]] = n
        p = probabilities(c, self.below)
        q = probabilities(c.sum(axis=1), self.whole)
        for s in range(len(self.names)):
            rows = np.flatnonzero(c[:, s])
            if not len(rows):
                continue
            more = np.abs(p[rows, s, None] - p[rows]) - np.abs(self.none[s] - self.none)
            self.pairs[s] += more.sum(axis=0)
            self.pairs[:, s] += (more * (c[rows] == 0)).sum(axis=0)  # the other source has none of this term
            f = p[rows, s] - q[rows]
            rows, f = rows[f > 0], f[f > 0]
            if len(f) > self.ranks:
                enough = f >= np.partition(f, -self.ranks)[-self.ranks]
                rows, f = rows[enough], f[enough]
            own = self.best[s] + [(-int(x), leaves[i][0]) for i, x in zip(rows, f)]
            self.best[s] = sorted(own)[: self.ranks]

    def rows(self, lang: str) -> Iterator[tuple]:
        for s, r in zip(*np.nonzero(self.pairs)):
            if s != r:
                yield lang, self.names[s], "pair", self.names[r], int(self.pairs[s, r])
        for s, best in zip(self.names, self.best):
            for f, term in best:
                yield lang, s, "term", term.decode(), -f


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, ranks: int = RANKS, width: int = WIDTH, held: int = HELD, leaves: int = LEAVES
) -> DataFrame:
    """One row per (lang, source) and other source of the language (part `pair`), and per each of its ``ranks`` most overused
    terms (part `term`): lang, source, part, item, value, rank."""
    tuned(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    occurring = written(rows.select("lang", "source").distinct(), "groups")
    tries = written(counted_tries(rows, width, held), "tries")
    merged = written(merged_tries(tries, least_docs, width, leaves), "merged_tries")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, int] = {}
        for b in batches:
            for r in b.to_pylist():
                for _, _, counts in walk(r["nodes"], r["names"]):
                    for s, n in counts.items():
                        sums[r["lang"], s] = sums.get((r["lang"], s), 0) + n
        yield from _batched(((*k, n) for k, n in sums.items()), pa.schema([("lang", pa.string()), ("source", pa.string()), ("n", pa.int64())]))

    found = merged.select("lang", "nodes", "names").mapInArrow(summed, "lang string, source string, n bigint").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = merged.groupBy("lang").agg(F.sum("leaves").alias("kept"))
    groups = occurring.join(found, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = written(groups, "group_totals")
    per_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.first("kept").alias("kept"))
    per_lang = written(per_lang.select("lang", F.col("sources.source").alias("all_names"), F.col("sources.n").alias("totals"), "kept"), "languages")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, Differences] = {}
        for b in batches:
            for r in b.to_pylist():
                d = of.get(r["lang"])
                if d is None:
                    d = of[r["lang"]] = Differences(r["all_names"], r["totals"], r["kept"], ranks)
                some, most = [], max(1, 500_000 // len(r["all_names"]))
                for term, _, counts in walk(r["nodes"], r["names"]):
                    some.append((term, counts))
                    if len(some) == most:
                        d.add(some)
                        some = []
                if some:
                    d.add(some)
        yield from _batched((x for lang, d in of.items() for x in d.rows(lang)), PAIRS, 5000)

    parts = written(sized_join(merged, per_lang, ["lang"]).mapInArrow(compared, "lang string, source string, part string, item string, value bigint"), "differences")
    discard(occurring, tries, merged, per_lang)
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    # every pair of sources is a row of the result; what both lack differs by a constant, over all kept terms
    none = F.expr(f"if(kept = 0, 0L, 1 + cast({SCALE} as decimal(20, 0)) * {SMOOTH} div (n + {SMOOTH} * kept))").cast("long")
    one = groups.select("lang", "source", "kept", none.alias("p"))
    other = groups.select("lang", F.col("source").alias("item"), none.alias("q"))
    base = one.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("kept") * F.abs(F.col("p") - F.col("q"))).alias("value"))
    own = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = base.unionByName(own).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(of_terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM d),
c AS (SELECT lang, source, item, count(*) AS n, count(DISTINCT i) AS docs FROM t GROUP BY lang, source, item),
k AS (SELECT lang, item, sum(n)::HUGEINT AS n FROM c GROUP BY lang, item HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (
  SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.item IS NOT NULL), 0)::HUGEINT AS n
  FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN k ON k.lang = c.lang AND k.item = c.item GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, k.item, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q
  FROM gn JOIN v ON v.lang = gn.lang JOIN k ON k.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.item = k.item),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.item = y.item AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
