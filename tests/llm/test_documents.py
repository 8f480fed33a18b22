"""Each document operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.llm import bpe_codec, jaccard_join, license_scan, pfair_mix, quality_knn, quality_rules, sharding, textnp, token_counts
from tidemark.llm.base import sized_join
from tidemark.llm.license_texts import FULL, TEXTS
from tidemark.llm.queries import QUERIES, SQL, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key string, h int, rank int, digest int, bits int, score int"
EDGE = [
    (1, "the cat sat on the mat today", "en", "a"), (2, "The  CAT sat\non the mat today", "en", "a"), (3, None, "en", None), (4, "", None, "a"), (5, " \t\n", "fr", "b"), (6, "one two", "fr", "b"),
    (7, "ONE two", None, None), (None, "the cat sat on the mat today", "en", "a"), (None, None, None, None), (8, "x" * 30_000, "de", "c"), (9, "a b c d e f " * 3000, "de", "c"), (9, "a b c d e f " * 3000, "de", "c"),
    (10, "naïve café   日本語 😀 " * 20, "fr", "b"), (11, "#$%& | <b> \x1c \x85 \xa0 end", "en", "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "i", 0, "k", 0, 0, 0, 0, 0) for r in EDGE], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def brute_stats(t):
    w = WORD.findall(t or "")
    grams = list(zip(w, w[1:], w[2:]))
    seen = Counter(grams)
    marked = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked))


def brute_rules(rows):
    """The whole of the quality rules in plain Python: (kept, d2 or None) for each (text, lang, source)."""
    q = quality_rules
    stats, vec = [], []
    for t, _, _ in rows:
        s = brute_stats(t)
        n, lines = max(s[0], 1), max(len([x for x in (t or "").split("\n") if WORD.search(x)]), 1)
        x = [math.log(max(s[1], 1) / n), math.sqrt(s[2] / n), math.sqrt(s[3] / lines), math.sqrt(s[4] / n)]
        stats.append(s)
        vec.append([int(math.floor(v * q.UNIT + 0.5)) for v in x])
    good = [i for i, s in enumerate(stats) if not (s[0] < 50 or 100 * s[4] > 50 * s[0])]
    size = Counter((rows[i][1], rows[i][2]) for i in good)
    pool = Counter()
    for (lang, _), n in size.items():
        if n < 200:
            pool[lang] += n
    groups = defaultdict(list)
    for i in good:
        lang, src = rows[i][1], rows[i][2]
        groups[(lang, src) if size[lang, src] >= 200 else lang if pool[lang] >= 200 else None].append(i)
    d2 = {}
    for members in groups.values():
        x = np.array([vec[i] for i in members], float)
        center = []
        for c in x.T:
            bins = sorted(math.floor(v / 8) for v in c)
            center.append((bins[(len(bins) + 1) // 2 - 1] * 8 + 4) / q.UNIT)
        mean, inv = np.array(center), np.diag(1 / q.FLOOR**2)
        for _ in range(6):
            d = x / q.UNIT - mean
            b = np.floor(np.log2(np.einsum("ij,jk,ik->i", d, inv, d) + 1e-6) * 16)
            order = np.sort(b)
            sub = x[b <= order[math.ceil(len(b) * 0.75) - 1]]
            mean = sub.mean(axis=0) / q.UNIT
            inv = np.linalg.inv(q.CONSISTENCY * np.cov(sub.T, bias=True) / q.UNIT**2 + np.diag(q.FLOOR**2))
        d = x / q.UNIT - mean
        d2 |= dict(zip(members, np.einsum("ij,jk,ik->i", d, inv, d)))
    return stats, [(i in d2 and d2[i] <= q.CUTOFF, d2.get(i)) for i in range(len(rows))]


def test_rules_equal_brute_force(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = docs.collect()
    stats, verdict = brute_rules([(r.text, r.lang, r.source) for r in rows])
    got = {r.id: r for r in quality_rules.judged(docs).collect()}
    assert len(got) == len(rows)
    for r, s, (kept, d2) in zip(rows, stats, verdict):
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == s and g.kept == kept
        assert (g.d2 is None) == (d2 is None) and (d2 is None or math.isclose(g.d2, d2, rel_tol=1e-6, abs_tol=1e-9))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet").collect()}
    clean = [got[i] for i, q in labels.items() if q == 1 and not got[i].base_failed]
    assert sum(g.kept for g in clean) == len(clean)
    assert any(not g.kept and not g.base_failed for g in got.values())


def test_rules_edge(edge, empty):
    got = quality_rules.judged(edge).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(brute_stats(r[1]) for r in EDGE)
    assert quality_rules.judged(empty).count() == 0


def test_rules_reject_the_extremes_of_each_statistic(spark):
    rng = random.Random(4)
    many = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(4000)]
    clean = [" ".join(rng.sample(many, 300)) for _ in range(300)]
    clean += ["\n".join([*(rng.sample(many, 60)), "again", "again"]) for _ in range(5)]  # one line twice
    few, lines, seen = many[:16], many[:2], set()
    while len(lines) < 200:  # one-word lines without a repeated three-word window
        w = rng.choice([w for w in few if (*lines[-2:], w) not in seen])
        seen.add((*lines[-2:], w))
        lines.append(w)
    half = rng.sample(many, 500)
    longer = [w * 3 for w in rng.sample(many, 300)]
    signs = [w[:4] + "#" for w in rng.sample(many, 300)]
    bad = ["\n".join(lines), " ".join(half[:122] + half[:122] + half[122:378]), " ".join(longer), " ".join(signs)]
    words, _, _, dup, repeat = brute_stats(bad[0])
    assert dup >= 0.9 * words and not repeat and 48 * brute_stats(bad[1])[0] < 100 * brute_stats(bad[1])[4] < 50 * brute_stats(bad[1])[0]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean + bad)]
    got = {r.id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(len(clean))) and not any(got[len(clean) + i].kept or got[len(clean) + i].base_failed for i in range(len(bad)))


def test_classifier(spark, sf, edge, empty):
    big = sf.replace("0.001", "0.01")
    got = QUERIES["op1_quality_knn"](spark, big).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.97
    model = quality_knn.train(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"))
    scores = quality_knn.scored(edge, model).collect()
    assert len(scores) == len(EDGE) and sum(r.score == 0 for r in scores) >= 4
    assert quality_knn.scored(empty, model).count() == 0
    none = quality_knn.train(edge, spark.createDataFrame([(None, 1), (1, None), (99, 0)], "doc_id long, quality int"))
    assert {r.score for r in quality_knn.scored(edge, none).collect()} == {0.0, 0.5}


def test_labels_without_texts_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}" if i >= 100 else None) for i in range(50, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality_knn.train(docs, labels, sample=20)
    assert sorted(model.labels) == [0] * 20 + [1] * 20


def test_ties_go_to_the_first_in_the_sample():
    rng = np.random.default_rng(2)
    for _ in range(50):
        cos = rng.integers(0, 6, (7, 400)) / 10 + rng.random((7, 400)) * 1e-8
        near, sim = quality_knn.nearest(cos, 7)
        want = [sorted(range(400), key=lambda j: (-round(c[j], 6), j))[:7] for c in cos]
        assert near.tolist() == want and np.allclose(sim, np.take_along_axis(cos, near, axis=1), atol=1e-6)
    assert quality_knn.nearest(np.ones((2, 3)), 7)[0].tolist() == [[0, 1, 2]] * 2


def test_neighbours_are_chosen_by_folds():
    texts = [f"good words number {i} here" if i % 2 else f"bad bad bad {i} bad" for i in range(40)]
    got = quality_knn.choose_neighbours(texts, [i % 2 for i in range(40)], [i // 2 % 4 for i in range(40)], (1, 3, 39))
    assert got[1] > 0.9 and set(got) == {1, 3, 39}


def test_votes_are_exact_cosines(docs):
    texts = [t for t in texts_of(docs).values()][:60]
    model = quality_knn.fit(texts[:40], [i % 2 for i in range(40)])
    v = model.embed(texts)
    want = []
    for x in v:
        near = sorted(range(40), key=lambda i: (-round(float(x @ model.vectors[i]), 6), i))[: quality_knn.NEIGHBOURS]
        w = [max(float(x @ model.vectors[i]), 0) for i in near]
        want.append(sum(a * (i % 2) for a, i in zip(w, near)) / sum(w))
    assert np.allclose(model.scores(texts, block=7), want, atol=1e-5)


def test_codec_equals_the_library(docs, edge, empty):
    lib = bpe_codec.codec(tokenizer("word_bpe_49k.json")).lib
    for df, rows in ((edge, [(r[0], r[1]) for r in EDGE]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        want = []
        for i, t in rows:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        for size in (16_384, 3, 0):
            got = bpe_codec.encoded_documents(df, tokenizer("word_bpe_49k.json"), dictionary=size).collect()
            assert sorted((r.id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe_codec.encoded_documents(empty, tokenizer("word_bpe_49k.json")).count() == 0


def test_a_tokenizer_that_may_look_across_white_space_gets_whole_texts(spark, docs):
    path = tokenizer("byte_bpe_50k.json")
    c = bpe_codec.codec(path)
    some = docs.limit(40)
    want = {r.doc_id: c.lib.encode(r.text, add_special_tokens=False).ids for r in some.collect()}
    got = bpe_codec.encoded_documents(some, path, dictionary=50).collect()
    assert not c.parts and {r.id: (r.n_tokens, r.ids_sha256) for r in got} == {i: (len(v), hashlib.sha256(" ".join(map(str, v)).encode()).hexdigest()) for i, v in want.items()}


def test_the_memo_is_bounded_and_dropped(docs, monkeypatch):
    c = bpe_codec.codec(tokenizer("word_bpe_49k.json"))
    c.forget()
    monkeypatch.setattr(bpe_codec, "MEMO", 200_000)
    texts = list(texts_of(docs).values())
    chunks = bpe_codec.Dictionary([], tokenizer("word_bpe_49k.json"))
    for at in range(0, len(texts), 5):
        for t, (n, ids, _) in zip(texts[at : at + 5], bpe_codec.encode_batch(c, texts[at : at + 5], chunks)):
            want = c.lib.encode(t, add_special_tokens=False).ids
            assert ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert sum(len(w) + len(e[1]) + len(e[2]) + bpe_codec.ENTRY for w, e in c.memo.items()) == c.held
        words = {w for t in texts[at : at + 5] for w in t.split()}
        assert c.held <= 100_000 + sum(3 * bpe_codec.ENTRY + 40 * len(w) for w in words)  # a full memo and one batch
    c.forget()
    assert not c.memo and not c.older and not c.held


def test_seams_that_disagree_are_widened_to_the_whole_text(monkeypatch):
    c = bpe_codec.codec(tokenizer("word_bpe_49k.json"))
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(900))
    raw, at, known = text.encode(), 0, []
    for end in bpe_codec.cuts(raw):
        if parts := bpe_codec.inner(raw[at:end]):
            import xxhash

            known.append((xxhash.xxh3_128_digest(raw[at:end]), np.array(c.ids(parts[1].split()), np.uint32).tobytes()))
        at = end
    chunks = bpe_codec.Dictionary(known, tokenizer("word_bpe_49k.json"))
    plan = bpe_codec.encode_with(c, raw, chunks)
    assert any(type(x) is tuple for x in plan) and any(type(x) is bytes for x in plan)
    monkeypatch.setattr(c, "agrees", lambda *words: False)
    assert bpe_codec.encode_with(c, raw, chunks) is None
    want = c.lib.encode(text, add_special_tokens=False).ids
    assert next(iter(bpe_codec.encode_batch(c, [text], chunks)))[:2] == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())


def test_reused_chunks_and_special_tokens():
    c = bpe_codec.codec(tokenizer("word_bpe_49k.json"))
    rng = random.Random(5)
    base = " ".join("".join(rng.choices("abcdeé'<|>.", k=rng.randint(1, 9))) for _ in range(3000))
    texts = [base[i : i + 9000] + " <|endoftext|>x<|startoftext|> " + base[:5000] for i in range(0, 9000, 700)]
    known = {}
    for t in texts:
        raw, at = t.encode(), 0
        for end in bpe_codec.cuts(raw):
            if parts := bpe_codec.inner(raw[at:end]):
                import xxhash

                known[xxhash.xxh3_128_digest(raw[at:end])] = np.array(c.ids(parts[1].split()), np.uint32).tobytes()
            at = end
        assert b"".join(raw[a:b] for a, b in zip([0, *bpe_codec.cuts(raw)], bpe_codec.cuts(raw))) == raw
    chunks = bpe_codec.Dictionary(list(known.items()), tokenizer("word_bpe_49k.json"))
    for t, (n, ids, _) in zip(texts, bpe_codec.encode_batch(c, texts, chunks)):
        want = c.lib.encode(t, add_special_tokens=False).ids
        assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert chunks.seen


def test_token_counts_equal_the_library(docs, edge, empty):
    path = tokenizer("piece_bpe_32k.model")
    m = token_counts.model(path)
    for df, rows in ((edge, [(r[0], r[1]) for r in EDGE]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        want = sorted((i or 0, len((t or "").encode()), len(m.encode(t or ""))) for i, t in rows)
        got = token_counts.token_counts(df, path).collect()
        assert sorted((r.id or 0, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0


def test_texts_that_the_model_rewrites_are_counted_whole(monkeypatch):
    path = tokenizer("piece_bpe_32k.model")
    real = token_counts.model(path)

    class Other:
        def normalize(self, text):
            return real.normalize(text).lower()

        def encode(self, text, **options):
            assert not options
            return real.encode(text.lower())

    monkeypatch.setattr(token_counts, "model", lambda p: Other())
    text = "Some Words HERE " * 900
    assert token_counts.count_huge(path, text, 300, 4) == len(real.encode(text.lower()))


@pytest.mark.parametrize("chunk, overlap", [(300, 4), (1000, 16), (5000, 64)])
def test_spliced_counts(docs, chunk, overlap):
    path = tokenizer("piece_bpe_32k.model")
    m = token_counts.model(path)
    longest = sorted(texts_of(docs).values(), key=len)[-6:]
    for t in [*longest, "a" * 9000, "  " * 3000 + "x y" * 900, "é" * 4000, "日本語 " * 2000, "a b\n\n\tc  d <s> </s>" * 500, "▁ ▁" * 2000]:
        assert token_counts.count_huge(path, t, chunk, overlap) == len(m.encode(t))


def test_licenses(spark, edge, empty):
    rows = [(0, "Copyright (c) 2020 Someone\n\n" + TEXTS[2][1].upper().replace(" ", "  "), "MIT", None), (1, TEXTS[2][1] + " And more.", None, None), (2, TEXTS[3][1].replace("WARRANTIES", "warranties"), "ISC", None), (3, "x\n  released under the MIT Licence!\ny", None, "MIT"), (4, "quotes Released under the MIT License. here", None, None), (5, None, None, None)]
    got = license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).orderBy("id").collect()
    assert [(r.id, r.license, r.notices) for r in got] == [(r[0], r[2], r[3]) for r in rows]
    assert license_scan.scan(edge).count() == len(EDGE) and license_scan.scan(empty).count() == 0


def test_licenses_do_not_depend_on_wrapping(spark):
    import textwrap

    heads = {"MIT": "MIT License\n\nCopyright (c) 2021 Some One <one@example.org>\n\n", "BSD-3-Clause": "Copyright 2001-2004 The Authors.\nAll rights reserved.\n\n", "BSD-2-Clause": "Copyright © The Holders, all rights reserved\n\n", "ISC": "ISC License\n\nCopyright (c) [year] [fullname]\n\n"}
    bodies = {name: text for name, text in TEXTS if not text.split("\n")[0].endswith(("License", "(MIT)"))}
    bodies["BSD-2-Clause"] = bodies["BSD-2-Clause"].replace("COPYRIGHT HOLDER ", "COPYRIGHT OWNER ")
    rows = [(name, f"{width} {name}", heads[name] + "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in bodies[name].split("\n\n"))) for name in heads for width in (*range(24, 90), 10_000)]
    assert any(line.lower().startswith(("copyright notice", "copyright holder")) for _, _, t in rows for line in t.split("\n"))
    # wrapped as it is published
    end = """INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY,"""
    mit = re.sub(r"\s+", " ", bodies["MIT"])
    rows.append(("MIT", "published", "MIT License\n\nCopyright (c) 2021 A\n\n" + mit.replace(re.sub(r"\s+", " ", end), end)))
    assert "\nAUTHORS OR" in rows[-1][2]
    rows += [(None, "cut", "Copyright (c) 2021 A\n\n" + "\n".join(x for x in bodies["MIT"].split("\n") if not x.startswith("COPYRIGHT"))), (None, "more", bodies["MIT"] + "\ncopyright holders may sue")]
    got = license_scan.scan(spark.createDataFrame([r[1:] for r in rows], "doc_id string, text string")).collect()
    assert {r.id: r.license for r in got} == {r[1]: r[0] for r in rows}


#: Written by hand: texts, their canonical forms and the licence that the whole text is.
BY_HAND = [
    ("licence licence license", "license license license", None),
    ("Whilst whilst: per cent-per cent?", "while while percent percent", None),
    ("sub-licence, sub\nlicence; SUB LICENSE", "sublicense sublicense sublicense", None),
    ("Copyright (c) 1999 Me\nThe licence", "the license", None),
    ("Copyright holder grants all rights", "copyright holder grants all rights", None),
    ("Copyright owner\nCopyright owner copyright owner", "copyright holder copyright holder copyright holder", None),
    ("© 2020 X\n\n(C) 2021 Y\nCOPYRIGHT 2022, Z\nwords", "words", None),
    ("sublicences licencesx xlicence", "sublicences licencesx xlicence", None),
    (" \n\t", "", None), (None, "", None),
    ("Released under the MIT Licence", "released under the mit license", None),
    ("\r\nLICENSED under the Apache Licence -- Version 2.0 (the *Licence*); you may not use this file except in compliance with the Licence.\n// You may obtain a copy of the Licence at\n//   http://www.apache.org/licences/LICENSE-2.0\n# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'as is' basis,\n without warranties or conditions of any kind, either express or implied.\nSee the Licence for the specific language governing permissions\n\n\nand limitations under the Licence", None, "Apache-2.0"),
    ("MIT Licence\n\nCopyright (c) 2014-2024 Jane Doe and contributors. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sub-license, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n", None, "MIT"),
]


def test_canonical_forms_by_hand_in_both_engines(spark):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame([(i, t) for i, (t, _, _) in enumerate(BY_HAND)], columns=["doc_id", "text"])
    want = {i: (hashlib.sha256(c.encode()).hexdigest() if c is not None else None, name) for i, (_, c, name) in enumerate(BY_HAND)}
    got = [(r.id, r.canonical_sha256, r.license) for r in license_scan.scan(spark.createDataFrame(documents)).collect()]
    con = duckdb.connect()
    con.register("documents", documents)
    rel = con.execute(SQL["op3_license_scan"])
    names = [d[0] for d in rel.description]
    for rows in (got, [(r[names.index("doc_id")], r[names.index("canonical_sha256")], r[names.index("license")]) for r in rel.fetchall()]):
        assert len(rows) == len(want)
        for i, digest, name in rows:
            assert name == want[i][1] and want[i][0] in (None, digest), BY_HAND[i][0]


def test_full_licenses_and_texts_of_the_caller(spark, monkeypatch):
    import textwrap

    rows = []
    for file, name in FULL.items():
        text = open(f"/usr/share/common-licenses/{file}", encoding="utf-8").read()
        rows += [(f"{file} as published", text, name), (f"{file} cut", text[: len(text) // 2], None)]
        rows.append((f"{file} re-wrapped", "\n\n".join(textwrap.fill(p, 61, break_on_hyphens=False, break_long_words=False) if "opyright" not in p else p for p in text.split("\n\n")), name))
    apache = open("/usr/share/common-licenses/Apache-2.0", encoding="utf-8").read()
    rows.append(("no appendix", apache[: apache.index("   APPENDIX")].replace("http:", "https:"), "Apache-2.0"))
    rows += [("own", "Do as you LIKE\nwith this.", "Own-1.0"), ("null", None, None), ("empty", " \n", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    own = spark.createDataFrame([("Own-1.0", "do as you like with this"), ("Own-2.0", "Do as you like, with this!"), ("None", None), ("None", "."), (None, "x")], "license string, text string")
    for most in (1 << 20, -1):  # broadcast or shuffled
        monkeypatch.setattr(license_scan, "sized_join", lambda *a, most=most: sized_join(*a, most=most))
        got = license_scan.scan(docs, known_texts=own).collect()
        assert {r.id: r.license for r in got} == {r[0]: r[2] for r in rows} and len(got) == len(rows)
    assert {r.id for r in license_scan.scan(docs).collect() if r.license} == {r[0] for r in rows if r[2]} - {"own"}


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate({i: i + 32 for i in range(65, 91)})) if t else []
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    return sets, links


@pytest.mark.parametrize("cell", [4, 512])
def test_jaccard_equals_brute_force(spark, docs, cell):
    rng = random.Random(3)
    rows = [(i, t) for i, t in texts_of(docs).items()][:80]
    base = [f"w{i}" for i in range(120)]
    for i in range(60):  # near copies of one text, around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = rng.choice(["Q", "R", "S"]) + str(rng.randrange(9))
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, "one two"), (2001, "ONE  two"), (2002, "one"), (2003, ""), (2004, None), (2005, "É a b c d"), (2006, "é a b c d")]
    sets, links = brute_links(rows)
    root = {}
    for i in range(len(rows)):
        if i not in root:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            root |= dict.fromkeys(seen, min(rows[j][0] for j in seen))
    want = sorted((rows[i][0], len(sets[i]), root[i], len(links[i])) for i in range(len(rows)))
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), cell=cell).collect()
    assert sorted((r.id, r.n_shingles, r.component_id, r.n_links) for r in got) == want


@pytest.mark.parametrize("small, block, few", [(3, 4, 16), (3, 4, 2)])
def test_jaccard_blocks_and_stars(spark, monkeypatch, small, block, few):
    rng, base, rows = random.Random(3), [f"w{i}" for i in range(120)], []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = rng.choice("QRS") + str(rng.randrange(9))
        rows.append((1000 + i, " ".join(w)))
    rows += [(i, " ".join(base[i // 3 :] + [f"z{j}" for j in range(i // 3)])) for i in range(30)]
    _, links = brute_links(rows)
    real, met = jaccard_join.verified, jaccard_join.met
    monkeypatch.setattr(jaccard_join, "verified", lambda *a: real(*a, block=block, small=small))
    monkeypatch.setattr(jaccard_join, "met", lambda f, percent: met(f, percent, few))
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), cell=16).collect()
    assert {r.id: r.n_links for r in got} == {rows[i][0]: len(links[i]) for i in range(len(rows))}
    root = {r.id: r.component_id for r in got}
    assert all(root[rows[i][0]] == root[rows[j][0]] for i in links for j in links[i]) and all(root[v] == v <= i for i, v in root.items())


def test_jaccard_links_through_rows_without_an_id(spark):
    w = [f"w{i}" for i in range(100)]
    near = [" ".join(w), " ".join([*w[:94], *(f"x{i}" for i in range(6))]), " ".join([*(f"y{i}" for i in range(6)), *w[6:94], *(f"x{i}" for i in range(6))])]
    other = [" ".join(f"v{i}" for i in range(j, 60)) for j in range(2)]
    rows = [(1, near[0]), (None, near[1]), (None, near[1]), (2, near[2]), (None, other[0]), (None, other[1]), (None, other[0].upper()), (3, None), (None, None)]
    _, links = brute_links(rows)
    assert 3 not in links[0] and links[0] == {1, 2} and links[4] == {5, 6}
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), component=True).collect()
    assert sorted((r.id or 0, r.component_id or 0, r.n_links) for r in got) == sorted([(1, 1, 2), (0, 1, 3), (0, 1, 3), (2, 1, 2), *[(0, 0, 2)] * 3, (3, 3, 0), (0, 0, 0)])
    assert len({r.component for r in got if r.component_id == 1}) == 1 and len({r.component for r in got if r.n_links and not r.component_id}) == 1


def test_cells_of_a_large_group_are_dealt_evenly(spark):
    cells = [("g", lo, hi) for hi in range(40) for lo in range(hi + 1)] + [("s", -1, hi) for hi in range(50)]
    df = spark.createDataFrame(cells, "cell string, lo int, hi int")
    at = df.select("cell", jaccard_join.place(F.xxhash64("cell"), 205).alias("at"))
    for cell, n in (("g", 820), ("s", 50)):
        tasks = Counter(r.at for r in at.where(F.col("cell") == cell).collect())
        assert max(tasks.values()) == -(-n // 205)


def test_jaccard_edge(edge, empty):
    got = sorted(((r.id or 0), r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.joined(edge).collect())
    assert got[0][:2] == (0, 0) and (0, 3, 1, 2) in got and (1, 3, 1, 2) in got and (2, 3, 1, 2) in got and got.count((9, 6, 9, 1)) == 2 and (6, 1, 6, 1) in got and (7, 1, 6, 1) in got
    assert len(got) == len(EDGE) and jaccard_join.joined(empty).count() == 0


@pytest.mark.parametrize("n", [1, 60, 200, 255, 260, 1000, 3000])
def test_bitmap_never_loses_a_pair(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))]
    for share in (0.99, 0.95, 0.9, 0.85):
        sets.append(np.unique(np.concatenate([sets[0][rng.random(len(sets[0])) < share], rng.integers(0, 2**63, n // 20, dtype=np.uint64)])))
    sets = [s for s in sets if len(s)] + [np.unique(rng.integers(0, 2**63, max(1, n * k // 8), dtype=np.uint64)) for k in (3, 8, 40)]
    bits = jaccard_join.Bitmaps([jaccard_join.bitmap(s) for s in sets])
    i, j = (x.ravel() for x in np.mgrid[0 : len(sets), 0 : len(sets)])
    for x, y, d in zip(i, j, bits.apart(i, j)):
        apart = len(np.setxor1d(sets[x], sets[y]))
        assert d <= apart and bits.apart(np.array([y]), np.array([x]))[0] == d
        if n >= 200 and 0.8 < len(sets[x]) / len(sets[y]) < 1.25 and apart > len(sets[x]) + len(sets[y]) - 40:
            assert d > 0.2 * (len(sets[x]) + len(sets[y])) / 2  # strangers are told apart


def spark_hash(*values):
    """The 64-bit hash of an int and longs as Spark chains it, without sign; nulls change nothing."""
    import struct

    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<i", values[0]), 42)
    for v in values[1:]:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h


def brute_shards(rows, k):
    """(id, size, crc, shard, slot) by plain sorting: within sources by hash, then all by fractional rank."""
    from fractions import Fraction

    by = defaultdict(list)
    for i, raw, source in rows:
        crc = zlib.crc32(raw)
        by["null" if source is None else "=" + source].append((spark_hash(20240607, i, crc), i is not None, i or 0, crc, len(raw) + 8, i))
    line = []
    for src, mine in by.items():
        for r, (*_, crc, size, i) in enumerate(sorted(mine, key=lambda x: x[:5]), 1):
            line.append((Fraction(2 * r - 1, 2 * len(mine)), src, r, i, size, crc))
    line.sort(key=lambda x: x[:3])
    n = len(line)
    return [(i, size, crc, at * k // n, at - -(-(at * k // n) * n // k)) for at, (*_, i, size, crc) in enumerate(line)]


def test_shards(docs, edge, empty):
    for df, n in ((docs, docs.count()), (edge, len(EDGE))):
        got = sharding.shard_rows(df, shards=7).collect()
        assert len(got) == n
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(7)) <= 1
        assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
        total = Counter(r.source_key for r in got)
        for rows in by.values():
            for s, c in Counter(r.source_key for r in rows).items():
                assert abs(c - total[s] * len(rows) / n) <= 2 + len(total)
    want = sorted((i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in EDGE)
    assert sorted((r.id or 0, r.size, r.text_crc32) for r in sharding.shard_rows(edge).collect()) == want
    assert sharding.shard_rows(empty).count() == 0
    for df, n, k in ((docs, docs.count(), 24), (edge, len(EDGE), 5), (docs.limit(3), 3, 24)):
        rows = [(r.doc_id, (r.text or "").encode(), r.source) for r in df.collect()]
        assert sorted(brute_shards(rows, k), key=str) == sorted(((r.id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_rows(df, shards=k).collect()), key=str)
    same = lambda df: sorted((r.id, r.shard, r.slot) for r in sharding.shard_rows(df).collect())
    assert same(docs) == same(docs.repartition(7))


def test_schedule_deviates_by_less_than_a_block():
    rng = random.Random(2)
    for _ in range(20):
        w = pfair_mix.whole_weights({str(i): rng.random() + 0.01 for i in range(rng.randint(1, 30))})
        slots, parts = pfair_mix.period(w), sum(w.values())
        at = {t: s for s, ts in slots.items() for t in ts}
        assert sorted(at) == list(range(parts))
        had = Counter()
        for t in range(parts):
            had[at[t]] += 1
            assert all(abs(had[s] * parts - w[s] * (t + 1)) < parts for s in w)


@pytest.mark.parametrize("targets, blocks", [
    ({"a": 0.9, "b": 0.1}, {"a": 9_500, "b": 900}), ({"a": 0.9995, "b": 0.0005}, {"a": 30_000, "b": 40}), ({"hot": 0.6} | {f"s{i}": 0.01 for i in range(40)}, {"hot": 60_000} | {f"s{i}": 900 + i for i in range(40)}),
    ({f"r{i}": math.sqrt(i * i * 37 + 1) for i in range(25)}, {f"r{i}": 7 + i * i for i in range(25)}), ({"big": 10**30, "odd": 1}, {"big": 50, "odd": 2}),
])
def test_schedule_keeps_the_requested_weights(targets, blocks):
    from fractions import Fraction

    plan = pfair_mix.phases(blocks, targets)
    assert Counter({s: sum(p["blocks"] for p in plan if p["src"] == s) for s in blocks}) == Counter(blocks)
    taken, left = set(), dict(blocks)
    for phase in range(max(p["phase"] for p in plan) + 1):
        parts = [p for p in plan if p["phase"] == phase]
        at, start = {}, parts[0]["start"]
        for p in parts:
            assert p["first"] == blocks[p["src"]] - left[p["src"]]
            for j in range(p["blocks"]):
                at[j // p["parts"] * p["length"] + p["slots"][j % p["parts"]]] = p["src"]
        assert sorted(at) == list(range(len(at))) and not taken & {start + t for t in at}
        taken |= {start + t for t in at}
        total = sum(Fraction(str(targets[s])) for s in left)
        due = {s: Fraction(str(targets[s])) / total for s in left}
        had = Counter()
        for t in range(len(at)):
            had[at[t]] += 1
            if t % 97 == 0 or t + 1 == len(at):
                assert all(abs(had[s] - w * (t + 1)) < 1 for s, w in due.items())
        left = {s: n - had[s] for s, n in left.items() if n > had[s]}
    assert not left and taken == set(range(sum(blocks.values())))


def brute_schedule(blocks, weights):
    """The source of each slot: of the blocks released by then the one that is due first (then the least name); a new phase
    whenever a source is used up."""
    from fractions import Fraction

    exact, left, out = {s: Fraction(str(w)) for s, w in weights.items()}, {s: n for s, n in blocks.items() if n}, []
    while left:
        total = sum(exact[s] for s in left)
        due = {s: exact[s] / total for s in left}
        had, t = dict.fromkeys(left, 0), 0
        while all(had[s] < left[s] for s in left):
            ready = [(math.ceil((had[s] + 1) / due[s]), s) for s in left if math.floor(had[s] / due[s]) <= t]
            source = min(ready)[1]
            had[source] += 1
            out.append(source)
            t += 1
        left = {s: n - had[s] for s, n in left.items() if n > had[s]}
    return out


@pytest.mark.parametrize("weights", [{"=a": 0.9, "=b": 0.1}, {"=a": 0.5, "=b": 0.3, "=c": 0.2}, {"=a": 7, "=b": 5, "=c": 1.25, "=d": 0.01}])
def test_phases_equal_brute_force(weights):
    rng = random.Random(3)
    for blocks in ({s: rng.randint(1, 400) for s in weights}, {s: 1 + int(3000 * w) for s, w in weights.items()}):
        at = {}
        for p in pfair_mix.phases(blocks, weights):
            for j in range(p["blocks"]):
                at[p["start"] + j // p["parts"] * p["length"] + p["slots"][j % p["parts"]]] = p["src"]
        assert [at[t] for t in sorted(at)] == brute_schedule(blocks, weights) and sorted(at) == list(range(len(at)))


def test_a_long_schedule_keeps_the_targets():
    parts = pfair_mix.phases({"a": 90_000, "b": 10_000}, {"a": 0.9, "b": 0.1})
    assert {p["src"]: (p["parts"], p["blocks"], p["length"]) for p in parts if not p["phase"]} == {"a": (9, 90_000, 10), "b": (1, 9_999, 10)}
    assert sum(p["blocks"] for p in parts) == 100_000
    with pytest.raises(ValueError, match="whole_weights"):
        pfair_mix.phases({"a": 10**8, "b": 10**8}, {"a": 0.123456789, "b": 0.876543211})


def test_mixed_rows_equal_brute_force(docs):
    rows = [(r.doc_id, r.source) for r in docs.collect()]
    sizes, block = Counter("null" if s is None else "=" + s for _, s in rows), 2
    weights = pfair_mix.whole_weights({s: math.sqrt(n) for s, n in sizes.items()})
    order = brute_schedule({s: -(-n // block) for s, n in sizes.items()}, weights)
    ranked = {s: sorted((i for i, x in rows if s == ("null" if x is None else "=" + x)), key=lambda i: (spark_hash(20240607, i), i)) for s in sizes}
    had, want = Counter(), []
    for slot, s in enumerate(order):
        want += [(i, had[s], slot, pos) for pos, i in enumerate(ranked[s][had[s] * block : had[s] * block + block])]
        had[s] += 1
    got = pfair_mix.scheduled(docs.select("doc_id", "source"), block=block).collect()
    assert sorted((r.doc_id, r.block, r.slot, r.pos) for r in got) == sorted(want)


def test_mixing(docs, edge, empty):
    for df, n in ((docs, docs.count()), (edge, len(EDGE))):
        got = pfair_mix.scheduled(df.select("doc_id", "source"), block=2).collect()
        assert len(got) == n
        cells = Counter((r.slot, r.pos) for r in got)
        assert max(cells.values()) == 1 and {r.slot for r in got} == set(range(max(r.slot for r in got) + 1))
        assert all(len({r.source for r in got if r.slot == s}) == 1 for s in {r.slot for r in got})
    out = pfair_mix.mixed(edge)
    assert out.columns == edge.columns and out.count() == len(EDGE)
    assert pfair_mix.scheduled(empty).count() == 0 and pfair_mix.mixed(empty).count() == 0
    weights = pfair_mix.scheduled(docs.select("doc_id", "source"), {"src0": 3, "src1": 1}, block=1).where("slot < 12").collect()
    assert len(weights) == 12


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["a bb a", None, "bb", "x" * 100 + " a", ""]
    w = textnp.words(texts)
    h = textnp.word_hashes(w)
    assert list(w.counts) == [3, 0, 1, 2, 0] and h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3
    textnp.STEP, old = 4, textnp.STEP
    try:
        assert (textnp.word_hashes(w) == h).all()
    finally:
        textnp.STEP = old


def test_registered_queries():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(QUERIES) <= names and "pipeline" in names
    assert set(SQL) <= set(QUERIES) and set(SQL) <= set(__spark_entry__.oracle_sql())
