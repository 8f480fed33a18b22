"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Vectors are dealt by a hash of their id into shards of bounded size, and shards into teams whose vectors fit into a task.
Queries are packed into blocks. A block first searches one pilot shard; the k-th best score found there is its first bound.
Then every team's shards go to one task for each ``SLICE`` of blocks, which builds their trees once and takes the small
blocks one after another: a shard moves once for every ``SLICE * BLOCK`` queries, and what moves for each block and team is
the block. While a block goes through the team's shards its k-th scores rise; tasks share the pilot's bounds, not more. In a
shard a block descends the tree level by level, keeping (query, node) pairs whose upper bound q.c + |q| r reaches the
query's k-th score, and takes the surviving leaves in order of their bounds. Bounds are compared so that ties are never lost.

A stated set of queries against all rows, in blocks: every block meets every team, as any exact search must allow, but
no pair of rows is ever emitted; each block and team gives at most k rows a query.

Scores are exact whole numbers. If the largest component's square times the dimension reaches 2^53, products are summed as
64-bit integers instead of doubles; if it reaches 2^63, a score might not fit and a ValueError says so.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows whose id is null. A query
never finds rows with its own id, repeated ones included. Equal scores go to the smaller id; of rows with equal ids and
scores one takes a rank each. With fewer candidates than k all are returned; an empty table gives an empty table.
Shorter vectors count as padded with zeros; a very long one makes all as long, and shards hold fewer of them. Columns that
aren't named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import partitions, runs, tuned, written

#: Most rows of a shard, queries of a block, rows of a leaf, shards of a team, blocks of a task; components of a shard.
SHARD, BLOCK, LEAF, GROUP, SLICE, CELLS = 8192, 1024, 128, 16, 64, 1 << 20
#: A score that is lower than any.
NONE = np.iinfo(np.int64).min


class Tree:
    """A balanced ball tree in heap order over the rows of one shard; its leaves hold about LEAF rows each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        order, bounds = np.arange(len(ids)), [np.array([0, len(ids)])]
        for _ in range(self.depth):
            cut = [0]
            for a, b in zip(bounds[-1], bounds[-1][1:]):
                part = order[a:b]
                if len(part) > 1:
                    spread = x[part].var(axis=0)
                    order[a:b] = part[np.argsort(x[part, int(spread.argmax())], kind="stable")]
                cut += [(a + b) // 2, b]
            bounds.append(np.array(cut))
        self.ids, self.x, self.bounds = ids[order], x[order], bounds
        self.reach = np.sqrt((x * x).sum(axis=1).max(initial=0))
        self.centers, self.radii = [], []
        for level in bounds:
            c = np.zeros((len(level) - 1, x.shape[1]))
            r = np.zeros(len(level) - 1)
            for i, (a, b) in enumerate(zip(level, level[1:])):
                if b > a:
                    c[i] = self.x[a:b].mean(axis=0)
                    r[i] = np.sqrt(((self.x[a:b] - c[i]) ** 2).sum(axis=1).max())
            self.centers.append(c)
            self.radii.append(r)


class Best:
    """The k best (score, id) of each query of a block, rising as shards are searched."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None) -> None:
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.full(n, NONE) if least is None else least

    @property
    def bound(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.least)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates that already reach their queries' bounds."""
        if not len(query):
            return
        touched, at = np.unique(query, return_inverse=True)
        n = len(touched)
        q = np.concatenate([np.repeat(np.arange(n), self.k), at])
        s = np.concatenate([self.score[touched].ravel(), score])
        i = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, also for NONE
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.score[touched] = s[order][keep].reshape(n, self.k)
        self.id[touched] = i[order][keep].reshape(n, self.k)


def search(tree: Tree, qid: np.ndarray, q: np.ndarray, best: Best, wide: bool = False) -> None:
    """Raise ``best`` by the rows of one shard. ``wide``: sums of products may not be exact in doubles."""
    if not len(tree.ids):
        return
    norm = np.sqrt((q * q).sum(axis=1))
    exact = q.astype(np.int64) if wide else q
    alive = np.ones((len(q), 1), bool)
    for level, (c, r) in enumerate(zip(tree.centers, tree.radii)):
        if level:
            alive = np.repeat(alive, 2, axis=1)
        upper = q @ c.T + norm[:, None] * r
        upper += 1e-6 * (1 + np.abs(upper) + norm[:, None] * tree.reach)  # rounding never prunes a tie
        alive &= upper >= best.bound[:, None]
    upper = np.where(alive, upper, -np.inf)
    order = np.argsort(-upper, axis=1)
    leaves = tree.bounds[-1]
    for step in range(order.shape[1]):
        leaf = order[:, step]
        open_ = np.flatnonzero(upper[np.arange(len(q)), leaf] >= best.bound)
        if not len(open_):
            break
        found: list[tuple] = []
        by = open_[np.argsort(leaf[open_], kind="stable")]
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            a, b = leaves[leaf[part[0]]], leaves[leaf[part[0]] + 1]
            rows = tree.x[a:b].astype(np.int64) if wide else tree.x[a:b]
            s = (exact[part] @ rows.T).astype(np.int64)
            ids = tree.ids[a:b]
            last, last_id = best.bound[part][:, None], np.where(best.score[part, -1] >= best.least[part], best.id[part, -1], np.iinfo(np.int64).max)[:, None]
            ok = ((s > last) | ((s == last) & (ids[None, :] < last_id))) & (ids[None, :] != qid[part][:, None])
            i, j = np.nonzero(ok)
            found.append((part[i], s[i, j], ids[j]))
        best.add(*(np.concatenate(x) for x in zip(*found)))


def _pack(f: pd.DataFrame) -> tuple[bytes, bytes]:
    x = np.array(f["x"].tolist(), np.int64)
    top = max(-int(x.min()) - 1, int(x.max()), 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
    return f["id"].to_numpy(np.int64).tobytes(), np.dtype(kind).char.encode() + x.astype(kind).tobytes()


def _rows(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x[1:], chr(x[0])).reshape(len(i), -1).astype(np.float64)


def packed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows dealt by a hash of their ids into ``n`` packs: (key, ids, x)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in runs(frames, [key]):
            ids, x = _pack(f)
            yield pd.DataFrame({key: [f[key].iloc[0]], "ids": [ids], "x": [x]})

    dealt = rows.withColumn(key, F.expr(f"cast(pmod(xxhash64(id), {n}) as int)"))
    return dealt.select(key, "id", "x").repartition(n, key).sortWithinPartitions(key, "id").mapInPandas(pack, f"{key} int, ids binary, x binary")


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): floor(scale * component) as whole numbers, without unusable vectors."""
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return rows.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


FOUND = "query_id long, vec_id long, score long"


def _answers(qid: np.ndarray, best: Best) -> pd.DataFrame:
    i, j = np.nonzero(best.score > NONE)
    return pd.DataFrame({"query_id": qid[i], "vec_id": best.id[i, j], "score": best.score[i, j]})


def top_k(df: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard: int = SHARD, block: int = BLOCK, group: int = GROUP, slice_: int = SLICE) -> DataFrame:
    """The ``k`` rows of highest inner product with each row that meets the condition ``queries`` (on ``id``)."""
    spark = df.sparkSession
    tuned(spark)
    raw = written(whole_vectors(df, id_col, vector_col, scale), "vectors")
    most = F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double")))))
    stats = raw.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr(queries), 1)).alias("q"), F.max(F.size("x")).alias("d"), most.alias("most")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = stats["most"] ** 2 * stats["d"]
    if reach >= 2**63:
        raise ValueError(f"inner products of {stats['d']} components up to {stats['most']:g} may not fit 64 bits; use a smaller scale")
    wide = reach >= 2**53
    vectors = raw.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(stats["d"]) - F.size("x"))))
    shard = max(1, min(shard, CELLS // stats["d"]))
    shards, blocks = -(-stats["n"] // shard), max(1, -(-stats["q"] // block))
    data = written(packed(vectors, "shard", shards), "shards")
    asked = written(packed(vectors.where(queries), "block", blocks), "queries").withColumnsRenamed({"ids": "qids", "x": "q"})

    def pilot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                qid, q = _rows(r.qids, r.q)
                best = Best(len(qid), k)
                search(Tree(*_rows(r.ids, r.x)), qid, q, best, wide)
                yield pd.DataFrame({"block": [r.block], "ids": [r.qids], "x": [r.q], "least": [best.bound.tobytes()]})

    first = asked.withColumn("shard", F.expr(f"cast(block % {shards} as int)")).join(data, "shard")
    bounded = written(first.repartition(blocks, "block").mapInPandas(pilot, "block int, ids binary, x binary, least binary"), "bounded")

    def team(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, trees = None, []
        for f in frames:
            for r in f.itertuples():
                if (r.team, r.part) != now:
                    now, trees = (r.team, r.part), []
                if r.least is None:
                    trees.append(Tree(*_rows(r.ids, r.x)))
                    continue
                qid, q = _rows(r.ids, r.x)
                best = Best(len(qid), k, np.frombuffer(r.least, np.int64))
                for t in trees:
                    search(t, qid, q, best, wide)
                yield _answers(qid, best)

    # a team's shards, then the blocks of a slice, in one task
    group = max(1, min(group, shards // partitions(spark)))
    teams, parts = -(-shards // group), -(-blocks // slice_)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = data.select(F.expr(f"shard div {group}").cast("int").alias("team"), every(parts).alias("part"), F.col("shard").alias("at"), "ids", "x", F.lit(None).cast("binary").alias("least"))
    sent = bounded.select(every(teams).alias("team"), F.expr(f"block div {slice_}").cast("int").alias("part"), F.col("block").alias("at"), "ids", "x", "least")
    many = min(teams * parts, 4096)
    placed = own.unionByName(sent).repartitionById(many, F.expr(f"cast((team * {parts} + part) % {many} as int)"))
    found = placed.sortWithinPartitions("team", "part", F.col("least").isNotNull(), "at").mapInPandas(team, FOUND)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
