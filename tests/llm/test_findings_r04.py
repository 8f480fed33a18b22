"""What the finding of round 4 was about: the second and third stage of the pipeline."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_documents import brute_links

from tidemark.llm import jaccard_join, quality_knn


def test_the_driver_gets_counts_of_the_sample_and_no_texts(spark, monkeypatch):
    """However long the texts are: 0.6 GB of long ones took more of the driver than it has."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma")) + str(rng.randrange(50)) for _ in range(20_000)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    kind, got = type(docs), []
    collect = kind.collect

    def spy(self):
        rows = collect(self)
        got.extend(sum(len(x) for x in r if isinstance(x, (str, bytes, bytearray))) for r in rows)
        return rows

    monkeypatch.setattr(kind, "collect", spy)
    model = quality_knn.train(docs, labels)
    monkeypatch.undo()
    used = [i for (i,) in docs.where(~quality_knn.held_out(F.col("doc_id"))).select("doc_id").orderBy("doc_id").collect()]
    want = quality_knn.fit([texts[i] for i in used], [i % 2 for i in used])
    assert len(got) == len(used) and max(got) <= 6 * quality_knn.TERMS < min(map(len, texts))
    assert all(np.array_equal(getattr(model, c), getattr(want, c)) for c in ("project", "vectors", "labels"))


def _cells(prefixes, n=100):
    """A cell for each token, in the order of the tokens, as ``possible_edges`` deals them."""
    before = {c: i + 1 for i, c in enumerate(("before1", "before2", "before3"))}
    rows = []
    for k, p in enumerate(prefixes):
        for at, t in enumerate(p):
            rows.append({"kind": 0, "token": t, "lo": 0, "hi": 0, "gid": k, "cls": bytes([k] * 16), "n": n, "pos": at, "bits": bytes(16), "block": 0} | {c: p[at - d] if at >= d else 0 for c, d in before.items()})
    return [f for _, f in pd.DataFrame(rows).sort_values(["token", "cls"]).groupby("token")]


def test_a_pair_meets_once_and_not_at_all_its_shingles():
    """Tasks that each have one cell of a pair made a row of it each: 1,007,221 rows at 0.6 GB, 77,935 at 0.1 GB."""
    prefixes = [[t for t in range(1, 21) if t % 7 != k] for k in range(5)]
    cells = _cells(prefixes)
    got = pd.concat([jaccard_join.met(f, 80) for f in cells])
    assert len(got) == 10 and len(got[["a", "b"]].drop_duplicates()) == 10
    far = _cells([[1, 2, 3, 4, 5, 6, 99], [1, 12, 13, 14, 15, 16, 99]])  # what they share is further off than members know
    assert sum(len(jaccard_join.met(f, 80)) for f in far) == 2


@pytest.mark.parametrize("cell", [3, 512])
def test_links_of_near_copies_with_many_common_shingles(spark, cell):
    rng, rows = random.Random(11), []
    for c in range(6):
        base = [f"w{c}_{i}" for i in range(60 + 15 * c)]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice((f"x{rng.randrange(6)}", f"y{rng.random()}"))
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: (r.component_id, r.n_links) for r in jaccard_join.joined(docs, cell=cell).collect()}
    _, links = brute_links(rows)
    root = {}
    for i in range(len(rows)):
        todo = [i] if i not in root else []
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += links[j]
    assert got == {i: (root[i], len(links[i])) for i in range(len(rows))}
    assert any(links.values() if isinstance(links, dict) else links)


def test_groups_of_one_name_still_link(spark, monkeypatch):
    """If two groups had one name, their shingles would have no order in common and none would be left out."""
    rng = random.Random(5)
    rows = []
    for c in range(3):
        base = [f"w{c}_{i}" for i in range(80)]
        for _ in range(12):
            words = list(base)
            words[rng.randrange(80)] = f"y{rng.randrange(4)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = F.xxhash64

    def clash(*cols):
        return F.pmod(real(*cols), F.lit(20)) if cols == ("pdigest", "n") else real(*cols)

    monkeypatch.setattr(jaccard_join.F, "xxhash64", clash)
    got = {r.id: r.component_id for r in jaccard_join.joined(docs).collect()}
    assert got == {i: i - i % 12 for i in range(36)}
