"""Periodic runs, divergence of sources and packing against brute force, and on nulls, empty and long texts, ties, repeats,
empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tidemark.llm import fit_packing, periodic_runs, source_divergence
from tidemark.llm.queries import QUERIES, SQL, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns have the names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, g int, a int, w int, p int, runs int, best int, length int, piece int, start int, offset int, prefix int, nodes int, kept int, __rank int"
TEXTS = [
    (1, "a b a b a b a b a b end", "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, " \t\n", "fr", "s"), (5, "one", "fr", "t"), (6, "x " * 9000, "de", "t"), (7, "x " * 9000, "de", "t"),
    (None, "la la la la la la di da", None, None), (None, "la la la la la la di da", None, None), (None, None, None, None), (8, "Straße ÉCOLE école 日本語 😀 x\x00y it's", "en", "s"), (9, "p q r s t " * 2000 + "p q", "de", "u"), (2**60 + 1, "A a A\x0ba\ta a", "en", "s"),
    (11, "one two\x85three\xa0four " * 30, "en", "t"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 0, "i", *[0] * 15) for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_runs(w):
    """Every maximal stretch of period q, by comparing each word with that q before; of equal stretches the smallest q."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(i, text):
    w = WORD.findall(text or "")
    if i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = brute_runs(w)
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    return (i, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("levels", [0, 1, 2, periodic_runs.LEVELS])
def test_runs_of_random_words_equal_brute_force(levels):
    rnd = random.Random(levels)
    for _ in range(300):
        docs = []
        for _ in range(rnd.randint(0, 5)):
            w, n = [], rnd.randint(0, 90)
            while len(w) < n:
                w += [rnd.choice("abc") for _ in range(rnd.randint(1, 5))] if rnd.random() < 0.5 else [rnd.choice("abcde") for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 7)
            docs.append([x.encode() for x in w])
        want, first = [], 0
        for d in docs:
            want += [(s + first, n, q) for s, n, q in brute_runs(d)]
            first += len(d)
        assert list(zip(*(x.tolist() for x in periodic_runs.runs_of(docs, levels)))) == want


def test_runs_names_are_exact():
    words = [[b"a", b"b"] * 40 + [b"c"], [b"a", b"b"] * 40]
    for k, name in enumerate(periodic_runs.name_levels(periodic_runs.first_names(words))):
        flat, step = [(d, w) for d, ws in enumerate(words) for w in ws], 1 << k
        windows = [tuple(flat[i : i + step]) for i in range(len(flat) - step + 1)]
        assert all((name[i] == name[j]) == (windows[i] == windows[j]) for i in range(len(windows)) for j in range(len(windows)) if name[i] >= 0 and name[j] >= 0)
    long = periodic_runs.runs_of([[b"w"] * 200_000])
    assert [x.tolist() for x in long] == [[0], [200_000], [1]]


def test_runs_query_equals_brute_force(spark, sf, docs):
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()]
    want = [brute_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got) == sorted(want, key=key) and sum(r[1] for r in got) > 10


def test_runs_edges(spark, edge):
    out = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(edge), "id", "text"))
    assert out.columns == ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted((brute_row(r[0], r[1]) for r in TEXTS), key=key)
    plain = {r.id: r for r in periodic_runs.periodic_runs(edge).collect()}
    assert [tuple(r) for r in plain[1].runs] == [(0, 10, 2)] and plain[1].collapsed == "a b end" and plain[2].runs == [] and plain[2].collapsed == ""
    assert [tuple(r) for r in plain[9].runs] == [(0, 10_002, 5)] and plain[2**60 + 1].collapsed == "A a A a a a"
    assert periodic_runs.periodic_runs(edge.where("false")).count() == 0


# ---- divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least_docs, ranks):
    docs_of, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]
        groups.add((lang, source))
        docs_of.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (x, t), n in docs_of.items() if x == lang and n >= least_docs), key=lambda t: t.encode())
        own = sorted(s for x, s in groups if x == lang)

        def p(c, n):
            return 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))

        total = {s: sum(count[lang, s, t] for t in kept) for s in own}
        q = {t: p(sum(count[lang, s, t] for s in own), sum(total.values())) for t in kept}
        ps = {s: {t: p(count[lang, s, t], total[s]) for t in kept} for s in own}
        for s in own:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(q[t] - ps[s][t], t.encode(), t) for t in kept if count[lang, s, t] and ps[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"held": 20, "leaves": 5, "width": 1}])
def test_divergence_equals_brute_force(spark, docs, edge, bounds):
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(edge.select("doc_id", "text", "lang", "source")).repartition(5)
    want = brute_divergence([(r.text, r.lang, r.source) for r in rows.collect()], 3, 7)
    got = source_divergence.divergence(rows, least_docs=3, ranks=7, **bounds)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 200


def test_divergence_edges(spark, edge):
    want = brute_divergence([(r[1], r[2], r[3]) for r in TEXTS], 1, 50)
    assert sorted(tuple(r) for r in source_divergence.divergence(edge, least_docs=1).collect()) == want
    nothing = source_divergence.divergence(edge)  # no term is in 30 documents: all pairs, without a difference
    assert sorted(tuple(r) for r in nothing.collect()) == brute_divergence([(r[1], r[2], r[3]) for r in TEXTS], 30, 50) and nothing.where("value <> 0").isEmpty()
    assert source_divergence.divergence(edge.where("false")).count() == 0


def test_divergence_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(SQL["op12_source_divergence"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op12_source_divergence"](spark, sf).collect()) == want


def test_tries_merge_in_any_order():
    rnd = random.Random(4)
    for _ in range(200):
        want, trie, blobs = {}, source_divergence.Trie(), []
        for _ in range(3):
            own = {}
            for _ in range(rnd.randint(0, 40)):
                w, source = bytes(rnd.choice(b"ab\xc3\xa9") for _ in range(rnd.randint(1, 6))), rnd.choice("xyz")
                for x in (want, own):
                    leaf = x.setdefault(w, [0, Counter()])
                    leaf[0] += 1
                    leaf[1][source] += 2
            blobs.append(source_divergence.dumped([(w, *own[w]) for w in sorted(own)]))
        for b in rnd.sample(blobs, 3):
            trie.merge(*b[:2])
        assert list(trie.walk()) == [(w, *want[w]) for w in sorted(want)]


def test_probabilities_are_exact():
    c, n = np.array([0, 1, 7, 10**15 - 3]), np.array([5, 10**9 + 7, 9 * 10**15, 9 * 10**15 - 1])
    assert source_divergence.probabilities(c, n).tolist() == [1 + 10**9 * (int(x) + 5) // int(y) for x, y in zip(c, n)]


# ---- packing


def fewest(items, limit):
    """The least number of sequences, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                k = bins.index(room)
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        go(i + 1, [*bins, limit - items[i]])

    go(0, [])
    return best[0]


def contents(patterns, limit):
    used = Counter()
    for times, content in patterns:
        assert times > 0 and sum(s * n for s, n in content) <= limit
        used.update({s: 0 for s, _ in content})
        for s, n in content:
            used[s] += times * n
    return used, sum(t for t, _ in patterns)


def test_reduction_keeps_a_best_packing():
    rnd, fixed_any, more = random.Random(5), 0, 0
    for _ in range(1500):
        limit = rnd.choice([10, 20, 30, 50])
        lo = rnd.choice([1, limit // 5, limit // 4])
        counts = Counter(rnd.randint(lo, limit) for _ in range(rnd.randint(0, 10)))
        fixed, rest = fit_packing.reduced(counts, limit)
        got, n = contents(fixed + fit_packing.best_fit(rest, limit), limit)
        best = fewest(list(counts.elements()), limit)
        assert got == counts and sum(t for t, _ in fixed) + fewest(list(Counter(rest).elements()), limit) == best
        fixed_any += bool(fixed)
        more += n > best
    assert fixed_any > 1000 and more < 15


def test_best_fit_equals_piece_by_piece():
    rnd = random.Random(6)
    for _ in range(500):
        limit = rnd.choice([10, 30, 97])
        counts = Counter(rnd.randint(1, limit) for _ in range(rnd.randint(0, 60)))
        rooms = []
        for x in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= x]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else limit) - x)
        assert contents(fit_packing.best_fit(counts, limit), limit) == (counts, len(rooms))


def check_packed(rows, texts, limit, path):
    lib = fit_packing.codec(path).lib
    want = Counter()
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), limit):
            part = ids[at : at + limit]
            want[i, at // limit, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_query(spark, sf, docs):
    path = tokenizer("word_bpe_49k.json")
    rows = QUERIES["op13_fit_packing"](spark, sf).collect()
    used, tokens = check_packed([r for r in rows], [(r.doc_id, r.text) for r in docs.collect()], 4096, path)
    assert used == -(-tokens // 4096)  # as few as can be


def test_packing_edges(spark, edge):
    path = tokenizer("word_bpe_49k.json")
    for limit in (64, 4096):
        rows = fit_packing.packed_documents(edge, path, limit=limit).collect()
        check_packed(rows, [(r[0], r[1]) for r in TEXTS], limit, path)
    assert fit_packing.packed_documents(edge.where("false"), path).count() == 0
    whole = fit_packing.sequences(edge, path, limit=64)
    lib, got = fit_packing.codec(path).lib, defaultdict(list)
    for r in whole.collect():
        assert len(r.ids) <= 64 and [p.offset for p in r.pieces] == list(np.cumsum([0] + [p.length for p in r.pieces])[:-1])
        for p in r.pieces:
            got[p.id, p.piece].append(tuple(r.ids[p.offset : p.offset + p.length]))
    for i, text in [(r[0], r[1]) for r in TEXTS if r[0] is not None]:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        assert [got[i, k] for k in range(-(-len(ids) // 64))] == [[tuple(ids[at : at + 64])] for at in range(0, len(ids), 64)]


def test_packing_of_any_lengths(spark):
    rows = spark.createDataFrame([(k, "x", 1 + k * k % 100) for k in range(400)] + [(None, "x", 50)] * 30, "id long, name string, length long").repartition(6)
    got = fit_packing.packed(rows, limit=100).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 430 and all(sum(n for _, n in x) <= 100 and sorted(o for o, _ in x) == list(np.cumsum([0] + [n for _, n in sorted(x)])[:-1]) for x in by.values())
    with pytest.raises(ValueError):
        fit_packing.packing({101: 1}, 100)
