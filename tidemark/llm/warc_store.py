"""WARC archives with a two-level capture index.

Writing: captures are range-partitioned and sorted by key (the URL with its host reversed, then the page id, then the
payload's digest). A task writes one archive of gzip members, an index of compressed blocks of ``ENTRIES`` keys with
their offsets, and a sparse directory with each block's first key. File names are unique to a task attempt and a file
counts only through the row its task returns, so a retried task leaves nothing that is read.

Reading: keys are looked up in their own order: a binary search over the archives' first keys, one in the archive's
directory, one range read of a block, one in the block, and one range read of the record.

Of captures with equal payloads of at least ``least`` bytes the one with the largest page id is written as a response
and the others as revisits that refer to it; shorter ones are all responses.

A null payload is an empty one; a null URL has an empty key; a capture with a null page id is always a response and no
other refers to it. Repeated rows (also of one page id) are written and found one by one; of equal payloads all rows with the largest
id are responses. A payload, however long, is one record, held whole with a few times its bytes while it is written or read.
An empty table gives an empty table. Columns that aren't named are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import partitions, scratch, sized_join, tuned, written

ENTRIES, LEAST, DATE = 128, 1000, "2024-01-01T00:00:00Z"
SHARD = "name string, first string, last string, records long, bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def surt(url: Column) -> Column:
    """The sort-friendly form of a URL: labels of the host from right to left, then port, path and query; no fragment."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?[^/?:]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(kind: str, page: int | None, url: str, payload: bytes, digest: str, refers: int | None, name: str = "", n: int = 0) -> bytes:
    """One record, uncompressed; ``name`` and ``n`` are its archive and its number there, which make its id unique. Page ids
    stand in a field of their own, since they may repeat."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(name, n)}>", f"X-Page: {'' if page is None else page}", f"WARC-Date: {DATE}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]
    head += [f"WARC-Payload-Digest: sha1:{b32}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(name: str, n: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{n}')}"


def info(name: str) -> bytes:
    """The record that an archive begins with."""
    body = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(name, -1)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}.warc.gz", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record as the reader returns it; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    page = fields["X-Page"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {"page_id": int(page) if page else None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = int(fields["X-Refers-To-Page"])
    else:
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(out["payload"]).hexdigest() != digest or len(out["payload"]) != out["payload_bytes"]:
            raise ValueError(f"record {page} is damaged")
    return out


def _writer(folder: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _filesystem(folder)
        name, at, first, last, n = uuid.uuid4().hex, 0, None, None, 0
        entries: list[str] = []
        directory: list[str] = []
        archive = index = None
        size = 0

        def flush() -> None:
            nonlocal size
            block = zlib.compress("\n".join(entries).encode())
            directory.append(f"{size}\t{len(block)}\t{entries[0].split(chr(9), 2)[2]}")
            index.write(block)
            size += len(block)
            entries.clear()

        for f in frames:
            for r in f.itertuples():
                if archive is None:
                    files.create_dir(root, recursive=True)
                    archive, index = files.open_output_stream(f"{root}/{name}.warc.gz", compression=None), files.open_output_stream(f"{root}/{name}.idx", compression=None)
                    start = gzip.compress(info(name), mtime=0)
                    archive.write(start)
                    at, first = len(start), r.key
                refers = None if pd.isna(r.original) else int(r.original)
                page = None if pd.isna(r.page) else int(r.page)
                kind = "revisit" if refers is not None and page is not None and refers != page else "response"
                member = gzip.compress(record(kind, page, r.url, bytes(r.payload), r.digest, refers, name, n), 6, mtime=0)
                archive.write(member)
                entries.append(f"{at}\t{len(member)}\t{r.key}")
                at, last, n = at + len(member), r.key, n + 1
                if len(entries) == ENTRIES:
                    flush()
        if archive is not None:
            if entries:
                flush()
            archive.close()
            index.close()
            with files.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write("\n".join(directory).encode())
            yield pd.DataFrame([(name, first, last, n, at)], columns=["name", "first", "last", "records", "bytes"])

    return write


def captures(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    tail = F.concat_ws(" ", F.coalesce(F.lpad(F.col("page").cast("string"), 20, "0"), F.lit("-")), F.col("digest"))
    key = F.concat_ws(" ", F.regexp_replace(surt(F.col("url")), r"[\t\r\n ]", "_"), tail)
    return rows.withColumn("key", key)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write all pages under ``folder``; returns the shard table (a row per archive)."""
    spark = pages.sparkSession
    tuned(spark)
    rows = captures(pages, id_col, url_col, body_col)
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page").alias("original"), F.count("page").alias("n")).where("n > 1")
    shared = written(shared.select("digest", "original"), "originals")
    rows = sized_join(rows, shared, ["digest"], "left").withColumn("original", F.when(F.col("size") >= least, F.col("original")))
    ranged = rows.select("key", "page", "url", "payload", "digest", "original").repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    return written(ranged.mapInPandas(_writer(folder), SHARD), "shards")


class Reader:
    """Looks keys up in the archives of a folder; holds one directory and one block at a time."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str]]) -> None:
        self.files, self.root = _filesystem(folder)
        self.shards = sorted(shards)
        self.firsts = [s[0] for s in self.shards]
        self.open: dict[str, object] = {}
        self.shard = self.block = None

    def _file(self, name: str):
        if name not in self.open:
            if len(self.open) > 16:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.files.open_input_file(f"{self.root}/{name}")
        return self.open[name]

    def _range(self, name: str, at: int, n: int) -> bytes:
        f = self._file(name)
        f.seek(at)
        return f.read(n)

    def find(self, key: str) -> bytes | None:
        """The record of the key."""
        i = bisect.bisect_right(self.firsts, key) - 1
        if i < 0:
            return None
        name = self.shards[i][2]
        if self.shard != name:
            with self.files.open_input_stream(f"{self.root}/{name}.dir", compression=None) as d:
                parts = [x.split("\t", 2) for x in d.read().decode().split("\n")]
            self.spans, self.keys = [(int(a), int(n)) for a, n, _ in parts], [k for _, _, k in parts]
            self.shard, self.block = name, None
        j = bisect.bisect_right(self.keys, key) - 1
        if j < 0:
            return None
        if self.block != j:
            lines = zlib.decompress(self._range(f"{name}.idx", *self.spans[j])).decode().split("\n")
            self.entries = [x.split("\t", 2) for x in lines]
            self.entry_keys, self.block = [e[2] for e in self.entries], j
        e = bisect.bisect_left(self.entry_keys, key)
        if e == len(self.entry_keys) or self.entry_keys[e] != key:
            return None
        return gzip.decompress(self._range(f"{name}.warc.gz", int(self.entries[e][0]), int(self.entries[e][1])))


def look_up(keys: DataFrame, folder: str, shards: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given keys (column ``key``), one row per key that is found."""
    spark = keys.sparkSession
    # one row per archive file, as many as the files that a reader lists anyway
    listed = spark.sparkContext.broadcast([(r["first"], r["last"], r["name"]) for r in shards.select("first", "last", "name").collect()])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(folder, listed.value)
        for f in frames:
            out = [parsed(raw) for raw in map(reader.find, f["key"]) if raw is not None]
            got = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            got["page_id"], got["refers_to"] = got["page_id"].astype("Int64"), got["refers_to"].astype("Int64")
            if not payloads:
                got["payload"] = None
            yield got

    ordered = keys.select("key").repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    return ordered.mapInPandas(read, RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write all pages and read each of them back through the index."""
    folder = scratch(pages.sparkSession, "warc")
    shards = write_archives(pages, folder, id_col=id_col, url_col=url_col, body_col=body_col)
    keys = captures(pages, id_col, url_col, body_col).select("key")
    return look_up(keys, folder, shards, payloads=False).drop("payload")
