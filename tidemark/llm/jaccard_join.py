"""Exact Jaccard join of documents on their sets of word n-grams: grouped prefix join.

1. A frequency sketch of all shingles (fixed size, summed slice by slice) gives one order of shingles, rare ones first.
   The order is a function of the shingle alone, so the prefix filter is exact however coarse the sketch.
2. Each text's set is hashed; documents with equal sets form a *class* (its smallest id stands for it), and classes with
   equal prefixes and sizes form a *group*. Only groups emit their prefix shingles.
3. Prefix shingles that occur in one group only are dropped. For the others, and for groups of
   several classes, members meet in cells: a shingle with many members is split into blocks, a cell for each pair of
   blocks, so no task holds an unbounded group. Members that also share one of the shared shingles just before meet there
   already and not again. Pairs must pass the size and the positional filter and a bitmap bound on
   the sets' difference that never loses a pair. Classes with many possible partners are held together by single edges;
   pairs are emitted only for classes with few, so their number is in proportion to the rows.
4. The sets of classes with possible partners are read again and compared exactly: small heaps whole, dense parts of
   large ones by pairs of blocks, other pairs as stars. This gives each class's number of links, and edges that hold
   linked classes together.
5. These edges give connected components by alternating star contractions.

Links are counted between documents: a document's links are its class's other members and the members of linked classes.

Null and empty texts, and texts without words, have an empty set and link with nothing; each is its own component. Texts
with fewer words than ``k`` have their whole sequence as one shingle. Rows with a null id form classes and are compared
like others (texts are fetched by a hash of the row) but can't name a component: one without any id has a null id. Repeated
rows are in one class and all are returned. Shingles of equal frequency are ordered by their hashes; no result depends on
the order. A very long text is held whole, with about 19 times its bytes, by the task that hashes it; a cell of compared
sets takes a bounded number of bytes unless one set alone is larger. An empty table gives an empty table. Columns that
aren't named are not read. Sets are compared as 64-bit hashes.

Folders of cut points are deleted once their frames have been used, but for the two that the result is read from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import discard, partitions, runs, sized_join, slices, tuned, written
from .textnp import mix, shingle_sets

#: Slots of the sketch (a power of two); least and most bits of a set's bitmap; most members of a block in a cell.
SLOTS, SLICES, BITS, CELL = 1 << 20, 64, (128, 1 << 15), 512


def _slot(s: np.ndarray) -> np.ndarray:
    return (mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)


def sketch(rows: DataFrame, k: int) -> np.ndarray:
    """For each slot the (log2) number of documents' shingles that fall into it, over all documents."""
    width = SLOTS // SLICES

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.uint32)
        for f in slices(frames, "text"):
            sets = shingle_sets(f["text"].tolist(), k)
            if sets:
                total += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS).astype(np.uint32)
        if total.any():
            parts = total.reshape(SLICES, width)
            yield pd.DataFrame({"slice": np.arange(SLICES), "counts": [p.tobytes() for p in parts]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for i, c in zip(f["slice"], f["counts"]):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, np.uint64 if len(c) == width * 8 else np.uint32).astype(np.uint64)
        if sums:
            yield pd.DataFrame({"slice": list(sums), "counts": [c.tobytes() for c in sums.values()]})

    out = np.zeros((SLICES, width), np.uint64)
    summed = rows.mapInPandas(count, "slice int, counts binary").repartition(SLICES, "slice").mapInPandas(add, "slice int, counts binary")
    for r in summed.collect():  # SLOTS counters, whatever the corpus
        out[r["slice"]] += np.frombuffer(r["counts"], np.uint64)
    return np.log2(out.ravel() + 1).astype(np.uint8)


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the global order: rare shingles first, ties by hash."""
    return s[np.lexsort((s, levels[_slot(s)]))]


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles of a set two linked sets can't both lack."""
    return n - -(-n * percent // 100) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the set's shingles in half as many cells or a few more (a power of two): two bitmaps of one size differ in no
    more bits than the sets in shingles. The halves of a bitmap, put together, are the bitmap of half the size.

    Unlinked sets of n shingles differ in nearly half of the cells, so in n / 4 bits at least, and linked ones in n / 4.5 at most.
    """
    size = min(max(1 << ((len(s) - 1) // 2).bit_length(), BITS[0]), BITS[1])
    bits = np.bincount((mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


class Bitmaps:
    """The bitmaps of some sets, compared at the size of the smaller one; linked sets' sizes are one step apart at most."""

    def __init__(self, bits: list[bytes]) -> None:
        size = np.array([len(b) // 8 for b in bits])
        self.level = np.log2(size).astype(np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by size: each set's row, and the rows
        for k in np.unique(self.level):
            own, larger = np.flatnonzero(self.level == k), np.flatnonzero(self.level == k + 1)
            at = np.full(len(bits), -1)
            at[own], at[larger] = np.arange(len(own)), len(own) + np.arange(len(larger))
            table = [np.frombuffer(b"".join([bits[i] for i in own]), np.uint64).reshape(-1, 1 << k)]
            if len(larger):
                halves = np.frombuffer(b"".join([bits[i] for i in larger]), np.uint64).reshape(-1, 2, 1 << k)
                table.append(halves[:, 0] ^ halves[:, 1])
            self.rows[int(k)] = at, np.concatenate(table)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sets i and j differ; 0 where their sizes don't allow a link."""
        out = np.zeros(len(i), np.int64)
        low, high = np.minimum(self.level[i], self.level[j]), np.maximum(self.level[i], self.level[j])
        for k in np.unique(low):
            which = np.flatnonzero((low == k) & (high <= k + 1))
            at, rows = self.rows[int(k)]
            for part in np.array_split(which, 1 + (len(which) << int(k)) // (1 << 22)):  # 32 MB at a time
                out[part] = np.bitwise_count(rows[at[i[part]]] ^ rows[at[j[part]]]).sum(axis=1, dtype=np.int64)
        return out


def digested(rows: DataFrame, levels, k: int, percent: int) -> DataFrame:
    """Per document: id, n (size of its set), digest of the set, prefix and its digest, bitmap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            out = []
            for i, s in zip(f["id"], shingle_sets(f["text"].tolist(), k)):
                if len(s):
                    p = ordered(s, levels.value)[: prefix_length(len(s), percent)]
                    out.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), p.astype(np.int64), xxhash.xxh3_128_digest(p.tobytes()), bitmap(s)))
                else:
                    out.append((i, 0, None, None, None, None))
            g = pd.DataFrame(out, columns=["id", "n", "digest", "prefix", "pdigest", "bits"])
            g["id"] = f["id"].array
            for c in f.columns[2:]:
                g[c] = f[c].array
            yield g

    more = "".join(f", {c} long" for c in rows.columns[2:])
    return rows.mapInPandas(run, "id long, n int, digest binary, prefix array<long>, pdigest binary, bits binary" + more)


CLS = np.dtype([("a", "<u8"), ("b", "<u8")])
CELL_KEY = ["kind", "token", "lo", "hi"]
#: The shared shingles just before a cell's own one in a member's prefix; 0: none.
BEFORE = ["before1", "before2", "before3"]


def cell_pairs(f: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows (i, j) of possible links in whole cells, sorted by cell and size: all cells at once, by distance in the order.

    Sizes rise within a cell, so a row that has met a partner too large for it is done.
    """
    n, pos, block, gid = (f[c].to_numpy(np.int64) for c in ("n", "pos", "block", "gid"))
    bits, before = Bitmaps(f["bits"].tolist()), f[BEFORE].to_numpy(np.int64)
    cell = np.zeros(len(f), np.int64)
    for c in CELL_KEY:
        x = f[c].to_numpy()
        cell[1:] |= x[1:] != x[:-1]
    cell = np.cumsum(cell)
    cross, token = (f["lo"] != f["hi"]).to_numpy(), (f["kind"] == 0).to_numpy()
    live, found = np.arange(len(f)), []
    for d in range(1, len(f)):
        live = live[live + d < len(f)]
        j = live + d
        near = (cell[j] == cell[live]) & (n[live] * 100 >= percent * n[j])
        live = live[near]
        if not len(live):
            break
        i, j = live, live + d
        # a cell of two blocks is for pairs across them; members of one group meet in the group's own cell
        ok = ~(cross[i] & (block[i] == block[j])) & ~(token[i] & (gid[i] == gid[j]))
        need = -(-percent * (n[i] + n[j]) // (100 + percent))  # least intersection of linked sets
        ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) + np.minimum(pos[i], pos[j]) >= need
        i, j, need = i[ok], j[ok], need[ok]
        ok = ~((before[i][:, :, None] == before[j][:, None, :]) & (before[i] != 0)[:, :, None]).any(axis=(1, 2))  # a pair of an earlier cell
        i, j, need = i[ok], j[ok], need[ok]
        ok = bits.apart(i, j) <= n[i] + n[j] - 2 * need
        found.append((i[ok], j[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def roots_of(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable by the edges (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def met(f: pd.DataFrame, percent: int, few: int = 16) -> pd.DataFrame:
    """(dense, a, b) for the possible pairs of these cells: a pair of which one class has few partners here stands for
    itself; classes with many partners are only held together, each by one edge (dense)."""
    i, j = cell_pairs(f, percent)
    names, at = np.unique(np.frombuffer(b"".join(f["cls"]), CLS), return_inverse=True)
    x, y = np.minimum(at[i], at[j]), np.maximum(at[i], at[j])
    code = np.unique(x * len(names) + y)
    x, y = code // len(names), code % len(names)
    partners = np.bincount(np.concatenate([x, y]), minlength=len(names))
    dense = np.minimum(partners[x], partners[y]) > few
    root = roots_of(len(names), x[dense], y[dense])
    tied = np.flatnonzero(root != np.arange(len(names)))
    a, b = np.concatenate([x[~dense], tied]), np.concatenate([y[~dense], root[tied]])
    return pd.DataFrame({"dense": np.arange(len(a)) >= (~dense).sum(), "a": [names[t].tobytes() for t in a], "b": [names[t].tobytes() for t in b]})


def class_table(docs: DataFrame) -> DataFrame:
    """One row per distinct set: digest, n, pdigest, bits, rep (its smallest id, if any), row (of its first row), copies."""
    own = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    got = docs.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("pdigest").alias("pdigest"), F.first("bits").alias("bits"), own.alias("own"), F.count(F.lit(1)).alias("copies"))
    return written(got.select("digest", "n", "pdigest", "bits", F.col("own.id").alias("rep"), F.col("own.row").alias("row"), "copies"), "classes")


def possible_edges(docs: DataFrame, classes: DataFrame, percent: int, cell: int) -> DataFrame:
    """(dense, a, b): classes (by digest) whose sets may be linked, as pairs or held together by dense edges.

    Groups go by a 64-bit name; should two have one name, their members meet in one cell and none is lost. Prefix shingles
    are shuffled once, as three numbers each; a shingle is in few groups compared to all the shingles that a task gets, so a
    common one is no skew. What is wide, a class's bitmap, is only joined to the shingles of several groups.
    """
    group = F.xxhash64("pdigest", "n").alias("gid")
    members = classes.select(group, F.col("digest").alias("cls"), "n", "bits")
    one = (F.min("pdigest") == F.max("pdigest")) & (F.min("n") == F.max("n"))
    several = written(classes.groupBy(group).agg(F.count(F.lit(1)).alias("m"), one.alias("one")).where("m > 1"), "several")
    groups = docs.where("n > 0").groupBy("pdigest", "n").agg(F.first("prefix").alias("prefix")).select(group, "prefix")  # the only shuffle of whole prefixes
    tokens = sized_join(groups, several.select("gid", "m"), ["gid"], "left").select("gid", F.coalesce("m", F.lit(1)).alias("m"), F.posexplode("prefix").alias("pos", "token"))
    same = W.partitionBy("token")
    counted = tokens.withColumns({"groups": F.count(F.lit(1)).over(same), "g": F.sum("m").over(same)}).where("groups > 1")
    shared = written(counted.select(F.lit(0).alias("kind"), "token", "gid", "pos", F.ceil(F.col("g") / cell).cast("int").alias("blocks")), "tokens")
    own = several.select(F.lit(1).alias("kind"), F.col("gid").alias("token"), "gid", F.lit(0).alias("pos"), F.ceil(F.col("m") / cell).cast("int").alias("blocks"))
    along = W.partitionBy("gid").orderBy("kind", "pos")
    # two groups of one name have no order in common
    earlier = {c: F.when(F.col("kind") == 0, F.lag("token", i + 1, 0).over(along)).otherwise(0) for i, c in enumerate(BEFORE)}
    shingles = shared.unionByName(own).withColumns(earlier if several.where("not one").isEmpty() else dict.fromkeys(BEFORE, F.lit(0).cast("long")))
    dealt = shingles.join(members, "gid").withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("kind", "token", "gid", "cls", "n", "pos", "bits", *BEFORE, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_cells(frames):
            yield met(f, percent)

    at = place(F.xxhash64("kind", "token"), partitions(classes.sparkSession))
    got = written(dealt.repartitionById(partitions(classes.sparkSession), at).sortWithinPartitions(*CELL_KEY, "n", "cls").mapInPandas(meet, "dense boolean, a binary, b binary").distinct(), "met")
    discard(several, shared)
    return got


def place(group: Column, n: int) -> Column:
    """The task of a cell. The block pairs (lo, hi) of one group go to tasks one after another from a random one on, so that
    the many cells of a large group are even, which hashing alone wouldn't make them."""
    step = F.when(F.col("lo") < 0, F.col("hi").cast("long")).otherwise(F.expr("cast(hi as long) * (hi + 1) div 2 + lo"))
    return F.pmod(F.pmod(group, F.lit(n)) + step, F.lit(n)).cast("int")


def whole_cells(frames: Iterator[pd.DataFrame], key: list[str] = CELL_KEY, size: int = 30_000) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames of about ``size`` rows that don't split a cell."""
    held: list[pd.DataFrame] = []
    for f in frames:
        held.append(f)
        if sum(map(len, held)) < size:
            continue
        f = pd.concat(held, ignore_index=True)
        last = (f[key] == f[key].iloc[-1]).all(axis=1).to_numpy()
        cut = len(f) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield f.iloc[:cut]
        held = [f.iloc[cut:]]
    if held:
        f = pd.concat(held, ignore_index=True)
        if len(f):
            yield f


def links_in_cell(f: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The members of a cell that have links in it: digest, linked (documents), root (a member they hang together with)."""
    star = f["lo"].iloc[0] < 0
    f = f.sort_values(["lead", "n"], ascending=[False, True], kind="stable").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in f["items"]]
    n, copies, block = f["n"].to_numpy(np.int64), f["copies"].to_numpy(np.int64), f["block"].to_numpy()
    cross = f["lo"].iloc[0] != f["hi"].iloc[0]
    linked, xs, ys = np.zeros(len(f), np.int64), [], []
    for i in range(1 if star else len(f)):
        j = np.arange(i + 1, len(f))
        j = j[(n[j] * percent <= n[i] * 100) & (n[i] * percent <= n[j] * 100)]
        if cross and not star:
            j = j[block[j] != block[i]]
        if not len(j):
            continue
        theirs = np.concatenate([sets[k] for k in j])
        at = np.minimum(np.searchsorted(sets[i], theirs), n[i] - 1)
        starts = np.concatenate([[0], np.cumsum(n[j])[:-1]])
        both = np.add.reduceat((sets[i][at] == theirs).astype(np.int64), starts)
        j = j[100 * both >= percent * (n[i] + n[j] - both)]
        linked[i] += copies[j].sum()
        linked[j] += copies[i]
        xs.append(np.full(len(j), i))
        ys.append(j)
    if not xs:
        return pd.DataFrame({"digest": [], "linked": [], "root": []})
    root = roots_of(len(f), np.concatenate(xs), np.concatenate(ys))
    some = np.flatnonzero(linked)
    names = f["digest"].to_numpy()
    return pd.DataFrame({"digest": names[some], "linked": linked[some], "root": names[root[some]]})


def verified(docs: DataFrame, classes: DataFrame, edges: DataFrame, k: int, percent: int, block: int = 128, small: int = 64, most_bytes: int = 8 << 20) -> DataFrame:
    """(digest, linked, root) for each class and cell with links: exact comparisons.

    Classes that hang together and are few are one cell, to which each set is sent once. In larger heaps dense parts are
    dealt into blocks of about ``block`` classes (fewer if their sets are large), and each pair of blocks is a cell; other
    pairs are compared as stars of at most ``small`` partners. Each pair is compared in exactly one cell. Cells get the
    compressed whole texts, which are smaller than their sets of hashes, and make the sets again.
    """
    spark = docs.sparkSession
    used: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(written(df, name))
        return used[-1]

    def heaps(e: DataFrame, name: str) -> DataFrame:
        got = components(e.select("a", "b"))
        used.append(got)
        both = got.select(F.col("node").alias("digest"), F.col("root").alias("comp")).unionByName(got.select(F.col("root").alias("digest"), F.col("root").alias("comp")).distinct())
        return kept(both, name)

    def sizes(members: DataFrame, name: str) -> DataFrame:
        return kept(members.join(light, "digest").groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")), name)

    light = classes.select("digest", "n", "row", "copies")
    inside = heaps(edges, "hang")
    wanted = kept(inside.join(light, "digest").select(F.col("row"), F.col("digest").alias("want")), "wanted")
    is_small = (F.col("m") <= small) & (F.col("size") * 8 <= most_bytes)
    placed = kept(sized_join(inside, sizes(inside, "heap_sizes").select("comp", is_small.alias("whole")), ["comp"]), "placed")
    one = placed.where("whole").select(F.col("comp").alias("cell"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(False).alias("lead"), F.lit(0).alias("block"), "digest")
    large = kept(edges.join(placed.where("not whole").select(F.col("digest").alias("a")), "a", "left_semi"), "large_edges")
    packs = heaps(large.where("dense"), "packs")
    per = sizes(packs, "pack_sizes").select("comp", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("size") * 8 / most_bytes)).cast("int").alias("blocks"))
    dealt = sized_join(packs, per, ["comp"]).withColumn("block", F.expr("cast(pmod(xxhash64(digest), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dense = dealt.select(F.col("comp").alias("cell"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.lit(False).alias("lead"), "block", "digest")
    pa, pb = (packs.select(F.col("digest").alias(c), F.col("comp").alias("p" + c)) for c in ("a", "b"))
    pairs = large.where("not dense").join(pa, "a", "left").join(pb, "b", "left").where("pa is null or pb is null or pa <> pb").select("a", "b")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / small), F.ceil(F.sum("n") * 8 / most_bytes)).cast("int")
    parts = pairs.join(light.select(F.col("digest").alias("b"), "n"), "b").groupBy("a").agg(parts.alias("parts"))
    pairs = kept(pairs.join(parts, "a").withColumn("hi", F.expr("cast(pmod(xxhash64(b), parts) as int)")), "pairs")
    rays = pairs.select(F.col("a").alias("cell"), F.lit(-1).alias("lo"), "hi", F.lit(False).alias("lead"), F.lit(0).alias("block"), F.col("b").alias("digest"))
    leads = pairs.select(F.col("a").alias("cell"), F.lit(-1).alias("lo"), "hi", F.lit(True).alias("lead"), F.lit(0).alias("block"), F.col("a").alias("digest")).distinct()

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()  # rows without an id may repeat
        for f in slices(frames, "text"):
            f = f.loc[np.array([w not in done for w in f["want"]], bool)].drop_duplicates(["want", "text"])
            got = shingle_sets(f["text"].tolist(), k)
            f = f.loc[np.array([xxhash.xxh3_128_digest(s.tobytes()) == w for s, w in zip(got, f["want"])], bool)]  # hashes of rows may clash
            done.update(f["want"])
            yield pd.DataFrame({"digest": f["want"].array, "packed": [zstandard.compress(t.encode("utf-8", "surrogatepass")) for t in f["text"]]})

    texts = sized_join(docs, wanted, ["row"])
    full = texts.mapInPandas(pack, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))
    rows = one.unionByName(dense).unionByName(rays).unionByName(leads).join(light.select("digest", "n", "copies"), "digest").join(full, "digest")
    key = ["cell", "lo", "hi"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in runs(frames, key):
            if len(f) > 1:
                sets = shingle_sets([zstandard.decompress(x).decode("utf-8", "surrogatepass") for x in f["packed"]], k)
                yield links_in_cell(f.assign(items=[s.tobytes() for s in sets]), percent)

    n = partitions(spark)
    links = written(rows.repartitionById(n, place(F.xxhash64("cell"), n)).sortWithinPartitions(*key).mapInPandas(compare, "digest binary, linked long, root binary"), "links")
    discard(*used)
    return links


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b) but the roots: root is the smallest node reachable.

    Alternating large and small stars; every round is aggregates and joins, and the round's edges are written. The caller
    may ``discard`` what is returned.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = [F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")]
    now = edges.agg(*sign).first()
    for i in range(most if now["n"] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour is tied to the smallest one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = written(nxt, f"edges{i}")
        discard(edges)
        edges, before, now = nxt, now, nxt.agg(*sign).first()
        if now == before:  # nothing moved
            break
    else:
        if now["n"]:
            raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.__dict__["written_to"] = edges.__dict__["written_to"]
    return out


def joined(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, carry: tuple[str, ...] = (), component: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links; and the columns ``carry`` (longs). With ``component``
    also that: a binary name of the component, null for empty sets, which components without any id have too."""
    spark = docs.sparkSession
    tuned(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carry)
    rows = rows.select("id", "text", F.xxhash64("id", "text").alias("row"), *carry)
    levels = spark.sparkContext.broadcast(sketch(rows, k))  # one byte for each slot
    digests = written(digested(rows, levels, k, percent), "digests")
    light = digests.select("id", "n", "digest", *carry)
    classes = class_table(digests)
    edges = possible_edges(digests, classes, percent, cell)
    links = verified(rows.select("text", "row"), classes, edges, k, percent)
    roots = components(links.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("digest").agg(F.sum("linked").alias("linked"))
    named = classes.select("digest", "rep", "copies").join(roots.withColumnRenamed("node", "digest"), "digest", "left").join(degree, "digest", "left")
    named = written(named.select("digest", "rep", "copies", F.coalesce("root", "digest").alias("root"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "named")
    least = written(named.where("n_links >= copies").groupBy("root").agg(F.min("rep").alias("least")), "least")  # classes with links
    per_class = written(sized_join(named, least, ["root"], "left").select("digest", F.coalesce("least", "rep").alias("component_id"), "n_links", F.col("root").alias("component")), "result")
    discard(classes, edges, links, roots, named, least)
    levels.unpersist()
    out = light.join(per_class, "digest", "left")
    name = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), name.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *carry, *(["component"] if component else []))
