"""A quality classifier by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed terms: its words, their shapes (first and last signs, length), and whether they stand in
repeated three-word windows or repeat the word before. Counts are damped, weighted by inverse document frequency and
projected to the leading singular directions of a labelled sample. The sample's vectors are broadcast (at most
``sample`` of them for each label, whatever the size of the corpus); every document's cosine with every one of them is
computed exactly, in blocks, and the labels of the ``k`` nearest vote, weighted by similarity.

Labels are learned only from rows of the training folds: crc32 of the id as text, modulo ``folds``, is not 0. Ids,
languages, sources and labels never enter a score, only texts do.

Null and empty texts, and texts without words, score 0. Repeated rows are scored one by one; a label whose id is null or
has no text is not used, of repeated labels the smallest counts. Without usable labels every text with words scores 0.5. An
empty table gives an empty table. Columns that aren't named are not read. Cosines are compared to six decimals; ties among
neighbours go to the first in the sample, which is ordered by id. A very long text is held whole, with about 30 times its
bytes, by the task that scores it.

``NEIGHBOURS`` was chosen by ``choose_neighbours`` inside the training folds; no held-out row took part in the choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SEED, slices, tuned
from .textnp import mix, windows, word_hashes, words

SAMPLE, TERMS, RANK, NEIGHBOURS = 2000, 4096, 48, 7
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 1


def term_counts(texts: list[str | None]) -> np.ndarray:
    """A row per text with the damped counts of its hashed terms."""
    w = words(texts)
    h = word_hashes(w)
    n = w.ends - w.starts
    last, before = w.ends - 1, np.maximum(w.ends - 2, w.starts)
    shape = _CLASS[w.buf[w.starts]] | _CLASS[w.buf[last]] << np.uint64(8) | _CLASS[w.buf[before]] << np.uint64(16) | np.minimum(n // 3, 9).astype(np.uint64) << np.uint64(24)
    window, at = windows(w, h, 3)
    doc = w.doc[at]
    order = np.lexsort((window, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (window[order][1:] == window[order][:-1])
    again = np.zeros(len(h), bool)
    again[at[order[1:][same]]] = True
    again[at[order[:-1][same]]] = True
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    half = TERMS // 2
    ids = [h % np.uint64(half), half + mix(shape) % np.uint64(half - 4), half * 2 - 4 + again.astype(np.int64) + 2 * echo]
    cells = np.concatenate([w.doc * TERMS + x.astype(np.int64) for x in ids])
    return np.log1p(np.bincount(cells, minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float32))


@dataclass
class Model:
    project: np.ndarray  # terms x rank, with the inverse document frequencies
    vectors: np.ndarray  # of the labelled texts, of length 1
    labels: np.ndarray

    def embed(self, texts: list[str | None]) -> np.ndarray:
        x = term_counts(texts)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        v = x @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None], k: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            if not len(self.labels):
                out[at : at + block] = 0.5 * (words(part).counts > 0)
                continue
            v = self.embed(part)
            near, sim = nearest(v @ self.vectors.T, k)
            weight = np.maximum(sim, 0)
            votes = (weight * self.labels[near]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
            out[at : at + block] = np.where(np.abs(v).sum(axis=1) > 0, np.clip(votes, 0, 1), 0)
        return np.round(out, 6)


def nearest(cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns and (rounded) cosines of the ``k`` nearest of each row, nearest first, ties by column."""
    n = cosines.shape[1]
    k = min(k, n)
    rounded = np.rint(cosines.astype(np.float64) * 1e6).astype(np.int64)
    order = rounded * n - np.arange(n)  # all of a row are different, so there is one set of the k greatest
    near = np.argpartition(-order, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(order, near, axis=1), axis=1), axis=1)
    return near, np.take_along_axis(rounded, near, axis=1) / 1e6


def fit(texts: list[str], labels: list[int], rank: int = RANK, seed: int = 7) -> Model:
    """The model of a labelled sample."""
    blocks = [term_counts(texts[i : i + 200]) for i in range(0, len(texts), 200)]
    return fitted(np.concatenate(blocks) if blocks else np.zeros((0, TERMS), np.float32), labels, rank, seed)


def fitted(x: np.ndarray, labels: list[int], rank: int = RANK, seed: int = 7) -> Model:
    """Singular directions of the sample's weighted term counts (which are changed), by subspace iteration."""
    if not len(x):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x *= idf
    rank = min(rank, len(x))
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).standard_normal((len(x), rank)).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    v = x @ q
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return Model((idf[:, None] * q).astype(np.float32), v.astype(np.float32), np.array(labels, float))


def choose_neighbours(texts: list[str], labels: list[int], folds: list[int], candidates: tuple[int, ...] = (1, 3, 5, 7, 11, 15, 25), threshold: float = 0.3) -> dict[int, float]:
    """The mean of both labels' recalls at the threshold for each number of neighbours, each fold scored by the others. Meant
    for a bounded sample of the training folds, on the driver."""
    y, fold, scores = np.array(labels), np.array(folds), {k: np.zeros(len(texts)) for k in candidates}
    for f in np.unique(fold):
        model = fit([t for t, g in zip(texts, fold) if g != f], y[fold != f].tolist())
        for k in candidates:
            scores[k][fold == f] = model.scores([t for t, g in zip(texts, fold) if g == f], k)
    return {k: float(np.mean([np.mean((s[y == c] >= threshold) == c) for c in (0, 1)])) for k, s in scores.items()}


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` training rows of each label that have a text, chosen by a seeded hash of their ids. Terms are
    counted where the texts are; the driver gets the counts that aren't 0, 24 KB of a text at most."""
    tuned(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    usable = usable.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    usable = usable.join(texts.select("id").distinct(), "id", "left_semi")  # labels without a text take no place in the sample
    mixed = F.xxhash64(F.lit(SEED), "id")
    chosen = usable.where("y = 0").orderBy(mixed, "id").limit(sample).unionByName(usable.where("y = 1").orderBy(mixed, "id").limit(sample))
    got = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    kind = got.schema["id"].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            for at in range(0, len(f), 200):
                part = f.iloc[at : at + 200]
                x = term_counts(part["text"].tolist())
                full = [np.flatnonzero(r) for r in x]
                yield pd.DataFrame({"id": part["id"].array, "y": part["y"].array, "terms": [c.astype(np.uint16).tobytes() for c in full], "counts": [r[c].tobytes() for r, c in zip(x, full)]})

    rows = sorted(got.select("id", "text", "y").mapInPandas(count, f"id {kind}, y int, terms binary, counts binary").collect(), key=lambda r: r["id"])  # at most two samples
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["terms"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    return fitted(x, [r["y"] for r in rows])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, score; and the columns ``carry`` (longs)."""
    spark = docs.sparkSession
    tuned(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            yield pd.DataFrame({"id": f["id"].array, "score": shared.value.scores(f["text"].tolist()), **{c: f[c].array for c in carry}})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carry)
    return rows.mapInPandas(run, "id long, score double" + "".join(f", {c} long" for c in carry))
