"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash over their bytes says so, so equal passages give equal chunks wherever they stand.
Three passes, none of which shuffles texts:

1. every chunk's digest is counted over the whole corpus (pre-aggregated; a digest with its owner's place is all that
   moves), and the ``dictionary`` most valuable chunks that occur twice or more are chosen;
2. each chosen chunk is cut out of its owner document and encoded once, by one task; the dictionary has at most
   ``dictionary`` entries of at most ``MOST`` bytes, and so a size bound that doesn't depend on the corpus;
3. documents are encoded where they are read: a known chunk's tokens are reused, the rest is encoded there.

A chunk may begin and end inside a word, so its first and last pieces up to white space are never reused: they are
joined with what stands beside them and encoded again, and if that has no white space either, with what stands beside
that, until the seam lies at white space. Then each seam is checked: the words at its two sides are encoded as one string,
and must give exactly the tokens that the two sides have by themselves. Where they don't, the whole text is encoded again
instead. Chunks beyond the bound are encoded wherever they occur, with the same result.

Words between white space are encoded one by one only if the tokenizer's own rules, read when it is loaded, can't look
across white space (``parts_words``); with any other tokenizer no chunk is reused and every text is encoded whole.

Memory of a worker: words and their tokens are remembered up to ``MEMO`` bytes, chunks written out up to ``SEEN`` bytes,
and both are dropped at the end of a task. A very long text is held whole, with about ten times its bytes.

Nulls and empty texts have no tokens. Repeated rows and null ids are encoded row by row (an id that repeats may own no
chunk if its texts differ: the digest is checked). An empty table gives an empty table; columns not named are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices, tuned, written

LEAST, MOST, BITS, DICTIONARY = 256, 4096, 10, 16_384
_GEAR = (np.random.default_rng(12345).integers(0, 1 << 32, 256, dtype=np.uint64)).astype(np.uint32)
_M = 0x2545F491
#: Bytes (estimated) of words kept with their tokens, and of chunks' tokens written out, in a task.
MEMO, SEEN = 80 << 20, 32 << 20
#: What an entry takes besides its bytes, and checked seams that are remembered.
ENTRY, SEAMS = 280, 50_000


def rolling(buf: np.ndarray) -> np.ndarray:
    """A 32-bit polynomial hash of the 16 bytes that end at each position, by doubling the window four times."""
    h, m, step = _GEAR[buf], _M, 1
    for _ in range(4):
        g = h.copy()
        g[step:] += h[:-step] * np.uint32(m)
        h, m, step = g, m * m & 0xFFFFFFFF, step * 2
    return h


def cuts(raw: bytes) -> list[int]:
    """The ends of the chunks of one text; each has LEAST to MOST bytes (the last may have fewer) and ends a character."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    buf = np.frombuffer(raw, np.uint8)
    marks = (np.flatnonzero((rolling(buf) & np.uint32((1 << BITS) - 1)) == 0) + 1).tolist()
    out, at, i = [], 0, 0
    while n - at > LEAST:
        while i < len(marks) and marks[i] < at + LEAST:
            i += 1
        end = min(marks[i] if i < len(marks) else n, at + MOST - 4, n)
        while end < n and buf[end] & 0xC0 == 0x80:
            end += 1
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


#: A word of ASCII letters and then signs other than the apostrophe and the angle brackets of special tokens.
LETTERS = re.compile(rb"([A-Za-z]+)([!-&(-/:;=?@\[-`{-~]*)").fullmatch


def parts_words(config: dict) -> bool:
    """Whether a tokenizer's own rules keep words between white space apart: signs are composed and cases lowered one by one,
    and its pieces are runs of letters, single digits and runs of signs, none of them white space.

    Such rules part a run of letters from the run of signs after it, too, so the library's model can be asked for these
    two pieces directly; all other words go through the whole library.
    """
    kinds = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
    byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    quoted, _, runs = pattern.partition("[")
    return kinds == ["NFC", "Replace", "Lowercase"] and byte_level and all(q.startswith("'") for q in quoted.split("|") if q) and "[" + runs == r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Codec:
    """A tokenizer with a bounded memo from words (between white space) to their tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.forget()
        # a decoded text without a decoder is its tokens, joined by one space
        self.parts = self.lib.decoder is None and parts_words(json.loads(self.lib.to_str()))
        size = max(self.lib.get_vocab(with_added_tokens=True).values()) + 1
        self.number = [b" %d" % i for i in range(size)]
        self.token = [b" " + (self.lib.id_to_token(i) or "").encode() for i in range(size)]
        special = [(t.content.encode(), i) for i, t in self.lib.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark, self.mark_id = special[0] if special else (None, None)

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. Words are joined by a special token, which the library takes out of a text first of all."""
        if self.mark is None:
            return [e.ids for e in self.lib.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)]
        ids, out, at = self.lib.encode(self.mark.join(words).decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, [], 0
        for _ in range(len(words) - 1):
            end = ids.index(self.mark_id, at)
            out.append(ids[at:end])
            at = end + 1
        return [*out, ids[at:]]

    def forget(self) -> None:
        """Drop all that is remembered."""
        self.memo: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.older: dict[bytes, tuple[int, bytes, bytes]] = {}  # words that weren't needed since the memo was last full
        self.held = 0  # bytes in the memo
        self.seams: set[bytes] = set()

    def _keep(self, word: bytes, entry: tuple) -> tuple:
        self.memo[word] = entry
        self.held += len(word) + len(entry[1]) + len(entry[2]) + ENTRY
        return entry

    def _learn(self, missing: list[bytes]) -> None:
        rest = []
        for w in missing:
            if (entry := self.older.pop(w, None)) is not None:
                self._keep(w, entry)
            elif m := LETTERS(w):
                letters, signs = m[1].lower(), m[2]
                entry = self._piece(letters)
                if signs:
                    tail = self._piece(signs)
                    entry = (entry[0] + tail[0], entry[1] + tail[1], entry[2] + tail[2])
                if signs or w != letters:
                    self._keep(w, entry)
            else:
                rest.append(w)
        plain = [w for w in rest if self.mark is None or self.mark not in w]
        marked = [w for w in rest if self.mark is not None and self.mark in w]
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            for word, ids in zip(part, self._encode(part)):
                self._keep(word, self.entry(ids))
        for w in marked:
            self._keep(w, self.entry(self.whole(w.decode("utf-8", "surrogatepass"))))

    def _piece(self, piece: bytes) -> tuple:
        """The entry of a run of small letters or of signs, which is a word of its own."""
        return self.memo.get(piece) or self._keep(piece, self.older.pop(piece, None) or self.entry([t.id for t in self.lib.model.tokenize(piece.decode())]))

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def entry(self, ids: list[int]) -> tuple:
        """Number of tokens; decimal ids and decoded text, a space before each token."""
        return len(ids), b"".join([self.number[i] for i in ids]), b"".join([self.token[i] for i in ids])

    def known(self, parts: list[list[bytes]]) -> dict:
        """A memo that has all these words. Of a full one the words that come again stay."""
        if self.held > MEMO // 2:
            self.memo, self.older, self.held = {}, self.memo, 0
        memo = self.memo
        missing = {w for p in parts for w in p if w not in memo}
        if missing:
            self._learn(list(missing))
        return memo

    def ids(self, words: list[bytes]) -> list[int]:
        memo = self.known([words])
        return [int(i) for w in words for i in memo[w][1].split()]

    def agrees(self, left: bytes, between: bytes, right: bytes) -> bool:
        """Whether two words with white space between them, encoded as one string, have the tokens that they have alone."""
        seam = left + between + right
        if seam in self.seams:
            return True
        if self.whole(seam.decode("utf-8", "surrogatepass")) != self.ids([left, right]):
            return False
        if len(self.seams) < SEAMS:
            self.seams.add(seam)
        return True

    def written_out(self, ids: list[int]) -> tuple[bytes, bytes]:
        return " ".join(map(str, ids)).encode(), self.lib.decode(ids, skip_special_tokens=False).encode()


@cache
def codec(path: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path)


def inner(chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
    """A chunk's first piece, what is between its first and last white space, and its last piece; None without two words' ends."""
    parts = chunk.split()
    if not parts:
        return None
    first = b"" if chunk[:1].isspace() else parts[0]
    last = b"" if chunk[-1:].isspace() else parts[-1]
    if len(parts) < 2 + bool(first) + bool(last):
        return None
    a = chunk.index(first) + len(first) if first else 0
    b = len(chunk) - len(last)
    return chunk[:a], chunk[a:b], chunk[b:]


SPACE = re.compile(rb"\s*").match


def encode_with(c: Codec, raw: bytes, known: dict[bytes, tuple]) -> list | None:
    """A text as a list of words to encode and of entries of ``known`` chunks to reuse, in order; None if a seam disagrees."""
    out: list = []
    at, held, before = 0, 0, b""  # held: where text that isn't encoded yet begins; before: the word that ends there
    for end in cuts(raw):
        chunk = raw[at:end]
        entry = known.get(xxhash.xxh3_128_digest(chunk))
        if entry is not None:
            parts = inner(chunk)
            a, b = at + len(parts[0]), end - len(parts[2])
            words = raw[held:a].split()
            # a seam where reuse begins and, if the text before it is encoded anew, one where the last reuse ended
            for left, right, gap in ((before, words[0] if words else b"", held), (words[-1] if words else before, parts[1].split(None, 1)[0], a)):
                if left and right and not c.agrees(left, SPACE(raw, gap)[0] or b" ", right):
                    return None
            out += words
            out.append(entry)
            held, before = b, parts[1].rsplit(None, 1)[-1]
        at = end
    words = raw[held:].split()
    if before and words and not c.agrees(before, SPACE(raw, held)[0] or b" ", words[0]):
        return None
    return out + words


def encode_batch(c: Codec, texts: list[str | None], known: dict[bytes, tuple]) -> Iterator[tuple[int, str, str]]:
    """For each text the number of tokens and the digests of the ids and of the decoded text."""
    plans = [encode_with(c, t.encode("utf-8", "surrogatepass") if t else b"", known) if c.parts else None for t in texts]
    memo = c.known([[w for w in p if type(w) is bytes] for p in plans if p])
    for p, t in zip(plans, texts):
        if p is None:
            got = c.whole(t or "")
            n, (ids, text) = len(got), c.written_out(got)
        else:
            got = [memo[x] if type(x) is bytes else x for x in p]
            counts, ids, texts_ = zip(*got) if got else ((), (), ())
            n, ids, text = sum(counts), b"".join(ids)[1:], b"".join(texts_)[1:]
        yield n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()


class Dictionary:
    """Encoded chunks by digest; written out when first used in a task, up to SEEN bytes at a time."""

    def __init__(self, rows: list[tuple[bytes, bytes]], path: str) -> None:
        self.raw, self.path = dict(rows), path
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, tuple] = {}
        self.held = 0

    def get(self, digest: bytes) -> tuple | None:
        entry = self.seen.get(digest)
        if entry is None and (raw := self.raw.get(digest)) is not None:
            if self.held > SEEN:
                self.forget()
            entry = self.seen[digest] = codec(self.path).entry(np.frombuffer(raw, np.uint32).tolist())
            self.held += len(entry[1]) + len(entry[2]) + ENTRY
        return entry


def shared_chunks(docs: DataFrame, path: str, dictionary: int = DICTIONARY) -> Dictionary:
    """Count all chunks, choose those whose reuse saves most, and encode each of them once."""
    spark = docs.sparkSession

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            out: dict[bytes, list] = {}
            for i, t in zip(f["id"], f["text"]):
                raw, at = t.encode("utf-8", "surrogatepass"), 0
                for end in cuts(raw):
                    if end - at >= LEAST:
                        d = xxhash.xxh3_128_digest(raw[at:end])
                        if d in out:
                            out[d][4] += 1
                        else:
                            out[d] = [d, i, at, end - at, 1]
                    at = end
            yield pd.DataFrame(list(out.values()), columns=["digest", "id", "at", "size", "n"])

    rows = docs.where("id is not null and text is not null")
    counted = rows.mapInPandas(digests, "digest binary, id long, at int, size int, n long").groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("id", "at", "size")).alias("own"))
    best = counted.where("n > 1").orderBy(F.desc(F.expr("(n - 1) * own.size")), "digest").limit(dictionary)
    owners = written(best.select("digest", "own.*"), "owners")
    pieces = rows.join(F.broadcast(owners), "id").select("digest", F.expr("substring(encode(text, 'UTF-8'), at + 1, size)").alias("chunk"))

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        try:
            for f in frames:
                out = []
                for d, chunk in zip(f["digest"], f["chunk"]):
                    if c.parts and xxhash.xxh3_128_digest(bytes(chunk)) == bytes(d) and (parts := inner(bytes(chunk))):
                        out.append((bytes(d), np.array(c.ids(parts[1].split()), np.uint32).tobytes()))
                yield pd.DataFrame(out, columns=["digest", "ids"])
        finally:
            c.forget()

    got = pieces.mapInPandas(encoded, "digest binary, ids binary").collect()  # at most ``dictionary`` rows
    return Dictionary([(bytes(r[0]), bytes(r[1])) for r in got], path)


def encoded_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    tuned(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = spark.sparkContext.broadcast(shared_chunks(rows, path, dictionary))

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, chunks = codec(path), known.value
        try:
            for f in slices(frames, "text", 500_000):
                out = pd.DataFrame(list(encode_batch(c, f["text"].tolist(), chunks)), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "id", f["id"].array)
                yield out
        finally:  # a worker is reused for other stages
            c.forget()
            chunks.forget()

    return rows.mapInPandas(encoded, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
