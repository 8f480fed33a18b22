"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than ``chunk`` characters is encoded as overlapping chunks with offsets. Two neighbours are spliced at a
position inside their overlap that is a token boundary in both and that is *proven stable*: no piece of the vocabulary
holds the two characters at its sides next to each other, so no merge can ever cross it and either side's tokens depend
on that side alone. If an overlap has no such position it is widened (doubled, up to the whole text) and encoded again.
The proof needs a model that writes spaces as its mark and changes nothing else; this is checked on every such text, by
the library's own normal form of it, and a text that it changes otherwise is encoded whole.

Nulls and empty texts have no bytes and no tokens. Rows are counted one by one: repeated rows and null ids stay as they
are, an empty table gives an empty table, and columns that aren't named are not read. Memory is bounded by a slice of
texts plus one text; a lost executor's partitions are simply counted again, since nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices, tuned

CHUNK, OVERLAP = 8192, 256


@cache
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def joined_pairs(path: str) -> frozenset[str]:
    """All pairs of adjacent characters inside a piece of the vocabulary."""
    m, out = model(path), set()
    for i in range(m.get_piece_size()):
        if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)):
            p = m.id_to_piece(i)
            out.update(a + b for a, b in zip(p, p[1:]))
    return frozenset(out)


def _begins(path: str, text: str, at: int) -> np.ndarray:
    """Where the tokens of ``text`` begin, which itself begins at ``at``."""
    begins = np.array([p.begin for p in model(path).encode(text, return_type="proto").pieces], np.int64)
    if not text.isascii():  # the library counts bytes
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))[begins]
    return begins + at


def stable_boundary(path: str, text: str, left: np.ndarray, right: np.ndarray, lo: int, hi: int) -> int | None:
    """The first proven boundary in (lo, hi) at which tokens begin in both encodings."""
    pairs = joined_pairs(path)
    for p in np.intersect1d(left[(left > lo) & (left < hi)], right[(right > lo) & (right < hi)]):
        a, b = text[p - 1], text[p]
        if (a + b).replace(" ", "▁") not in pairs:
            return int(p)
    return None


def count_huge(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of one text, from overlapping chunks spliced at stable boundaries."""
    if model(path).normalize(text) not in (plain := text.replace(" ", "▁"), "▁" + plain):
        return len(model(path).encode(text))
    total, begin, start = 0, 0, 0  # begin: of the current chunk; start: its first position that isn't counted yet
    end = min(len(text), chunk + overlap)
    here = _begins(path, text[:end], 0)
    while end < len(text):
        reach = overlap
        while True:
            nxt = end - reach
            if nxt <= start:
                break
            after_end = min(len(text), nxt + chunk + reach)
            there = _begins(path, text[nxt:after_end], nxt)
            cut = stable_boundary(path, text, here, there, max(nxt, start), end)
            if cut is not None:
                break
            reach *= 2
        if nxt <= start:  # no stable boundary in the whole chunk: take a chunk twice as long
            end = min(len(text), begin + 2 * (end - begin))
            here = _begins(path, text[begin:end], begin)
            continue
        total += int(((here >= start) & (here < cut)).sum())
        begin, start, end, here = nxt, cut, after_end, there
    return total + int((here >= start).sum())


def count_tokens(path: str, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if t and len(t) <= chunk + overlap]
    for i, ids in zip(short, model(path).encode([texts[i] for i in short], num_threads=1) if short else []):
        out[i] = len(ids)
    for i, t in enumerate(texts):
        if t and len(t) > chunk + overlap:
            out[i] = count_huge(path, t, chunk, overlap)
    return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    tuned(docs.sparkSession)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            yield pd.DataFrame({"id": f["id"].array, "n_bytes": f["n_bytes"].array, "n_tokens": count_tokens(model_path, f["text"].tolist())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInPandas(counted, "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
