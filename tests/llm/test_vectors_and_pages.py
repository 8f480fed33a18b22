"""Top-k search and WARC archives against brute force."""

import gzip
import hashlib

import numpy as np
import pytest

from tidemark.llm import topk_search, warc_store
from tidemark.llm.base import scratch


def brute_top(rows, k):
    out = []
    usable = [(i, v) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: np.floor(64 * np.array(v, float)) for i, v in usable}
    for q in sorted(i for i in x if i % 20 == 0):
        best = sorted(((-int(x[q] @ v), i) for i, v in x.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard, block, group, slice_", [(8192, 1024, 4, 64), (40, 3, 2, 4)])
def test_top_k(spark, shard, block, group, slice_):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 700)]  # ties
    rows += [(1000, None), (1020, [None] * 6), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, [9.0] * 6), (1080, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = topk_search.top_k(df, "id % 20 = 0", 20, shard=shard, block=block, group=group, slice_=slice_).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 20)


@pytest.mark.parametrize("size", [3e5, 2e7])
def test_top_k_beyond_exact_doubles(spark, size):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.integers(-size, size, 3)]) for i in range(200)]
    rows += [(i, [size, size + (i - 200) / 64, -size]) for i in range(200, 240)]  # scores that are apart by less than a double tells
    want = brute_exact(rows, 20)
    assert max(abs(s) for *_, s in want) > 2 ** (40 if size < 1e6 else 53)
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0", 20, shard=50, block=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def brute_exact(rows, k):
    x = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows}
    out = []
    for q in sorted(i for i in x if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(x[q], v)), i) for i, v in x.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_top_k_refuses_scores_beyond_64_bits(spark):
    for big in (3e9, 1e300):
        df = spark.createDataFrame([(20, [big, 1.0]), (40, [big, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="64 bits"):
            topk_search.top_k(df, "id % 20 = 0", 20)


def test_top_k_with_few_rows(spark):
    df = spark.createDataFrame([(20, [1.0]), (40, [2.0])], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, "id % 20 = 0", 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(20, 1, 40, 64 * 128), (40, 1, 20, 64 * 128)]
    assert topk_search.top_k(df.where("false"), "id % 20 = 0", 20).count() == 0
    assert topk_search.top_k(df, "id % 7 = 1", 20).count() == 0


PAGES = [
    (1, "http://a.example/x?y=1#f", "p" * 2000), (2, "http://b.a.example:80/", "p" * 2000), (3, None, "p" * 2000), (4, "http://a.example/x?y=1", "short"), (5, "http://a.example/z", "short"), (6, "ftp:/odd\turl\r\n", None),
    (None, "http://a.example/", "p" * 2000), (7, "http://a.example/é", "é\r\n\r\n" * 700), (8, "http://a.example/é", "é\r\n\r\n" * 700), (8, "http://c.example/", "é\r\n\r\n" * 700), (9, "", ""),
]


def expected(rows):
    largest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[h] = max(largest.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        o = largest.get(h, i) if i is not None and len(raw) >= 1000 else i
        out.append((i or 0, len(raw), hashlib.sha1(raw).hexdigest(), "response" if o == i else "revisit", None if o == i else o))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 0, "x") for r in PAGES], "page_id long, url string, html string, key int, digest string").repartition(3)
    got = warc_store.round_trip(df).collect()
    assert sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(PAGES)
    assert warc_store.round_trip(df.where("false")).count() == 0


def test_archives_are_plain_warc_and_payloads_come_back(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = scratch(spark, "test-warc")
    shards = warc_store.write_archives(pages, folder)
    keys = warc_store.captures(pages, "page_id", "url", "html").select("key")
    back = {r.page_id: r for r in warc_store.look_up(keys, folder, shards).collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    for i, r in back.items():
        source = back[r.refers_to] if r.record_type == "revisit" else r
        assert bytes(source.payload).decode() == html[i]
    root = folder.removeprefix("file:")
    name = shards.first()["name"]
    raw = gzip.open(f"{'/' + root.lstrip('/')}/{name}.warc.gz").read()
    import re

    ids = re.findall(rb"\r\nWARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)\r\n", raw)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and len(ids) == len(set(ids)) == shards.where(f"name = '{name}'").first()["records"] + 1
    assert b"\r\nContent-Type: application/warc-fields\r\n" in raw
    missing = spark.createDataFrame([("zzz",), ("",), ("com,example)/none 0",)], "key string")
    assert warc_store.look_up(missing, folder, shards).count() == 0


def test_sort_keys(spark):
    df = spark.createDataFrame([("http://u:p@www.A.example:8080/p?q#f",), ("odd",), (None,)], "u string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(warc_store.surt(F.col("u"))).collect()] == ["example,a,www):8080/p?q", ")odd", ")"]
