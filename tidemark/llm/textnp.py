"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
#: Bytes hashed at a time; one word longer than this is hashed alone.
STEP = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    buf: np.ndarray  # the bytes of all texts, a line feed after each
    starts: np.ndarray  # byte positions of words
    ends: np.ndarray
    doc: np.ndarray  # the text of each word
    first: np.ndarray  # for each text its first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: list[str | None]) -> Words:
    blobs = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buf = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    ends_of_docs = np.cumsum([len(b) + 1 for b in blobs]) if blobs else np.zeros(0, np.int64)
    gap = SPACE[buf]
    before = np.empty_like(gap)
    before[:1] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    doc = np.searchsorted(ends_of_docs, starts, side="right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Words(buf, starts, ends, doc, first)


def word_hashes(w: Words, lower: bool = False) -> np.ndarray:
    """One hash per word; equal words have equal hashes, wherever they stand."""
    out = np.empty(len(w.starts), np.uint64)
    at = 0
    while at < len(w.starts):
        end = max(at + 1, int(np.searchsorted(w.ends, w.starts[at] + STEP)))
        lo, hi = w.starts[at], w.ends[end - 1]
        b = w.buf[lo:hi]
        b = (LOWER[b] if lower else b).astype(np.uint64) + np.uint64(1)
        s, n = w.starts[at:end] - lo, w.ends[at:end] - w.starts[at:end]
        inside = np.arange(hi - lo, dtype=np.int64)
        reach = np.diff(np.append(s, hi - lo))
        inside -= np.repeat(s, reach)
        valid = inside < np.repeat(n, reach)
        b *= _power(int(n.max()) + 1)[np.where(valid, inside, 0)]
        b *= valid
        out[at:end] = mix(np.add.reduceat(b, s) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = end
    return out


def windows(w: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words that lie in one text, and the index of each window's first word."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :])
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + j]
    return mix(acc + np.uint64(k)), at


def shingle_sets(texts: list[str | None], k: int = 5, lower: bool = True) -> list[np.ndarray]:
    """For each text its sorted distinct ``k``-word shingles as hashes; fewer words than ``k`` make one shingle, none make none."""
    w = words(texts)
    h = word_hashes(w, lower)
    s, at = windows(w, h, k)
    cut = np.searchsorted(at, w.first)
    out = []
    for i, n in enumerate(w.counts):
        if n >= k:
            out.append(np.unique(s[cut[i] : cut[i + 1]]))
        elif n:
            acc = np.zeros(1, np.uint64)
            for x in h[w.first[i] : w.first[i + 1]]:
                acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + x
            out.append(mix(acc + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
