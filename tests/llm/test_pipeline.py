"""The pipeline's stages, each on its own input, against a plain Python version."""

import hashlib
import zlib

import corpus_pipeline
from test_documents import brute_links, brute_rules

from tidemark.llm import bpe_codec, quality_knn
from tidemark.llm.queries import tokenizer


def test_stages(spark, sf, tmp_path):
    big = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    docs = docs.unionByName(docs.limit(1))  # a repeated row
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, big).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = ([r for r in before.collect()], docs.collect(), before.columns, docs.columns)
    for name in list(out)[:-1]:
        assert out[name][2] == out[name][3]

    rows, got, *_ = out["quality_rules"]
    _, verdict = brute_rules([(r.text, r.lang, r.source) for r in rows])
    assert sorted(got) == sorted(r for r, (kept, _) in zip(rows, verdict) if kept)

    rows, got, *_ = out["quality_classifier"]
    table = spark.read.parquet(f"{big}/documents.parquet").collect()  # whatever earlier stages have left
    train = sorted((r.doc_id, r.text) for r in table if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5)
    model = quality_knn.fit([t for _, t in train], [labels[i] for i, _ in train])
    scores = model.scores([r.text for r in rows])
    assert sorted(got) == sorted(r for r, s in zip(rows, scores) if s >= corpus_pipeline.LEAST_SCORE)

    rows, got, *_ = out["ngram_jaccard_join"]
    rows = sorted(set(rows))
    _, links = brute_links([(r.doc_id, r.text) for r in rows])
    keep, seen = set(), set()
    for i in range(len(rows)):  # rows are in the order of their ids
        if i not in seen:
            keep.add(i)
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    todo += links[j]
    assert sorted(got) == sorted(rows[i] for i in keep)

    rows, got, *_ = out["mixing"]
    assert sorted(got) == sorted(rows)

    rows, got, *_ = out["bpe"]
    lib = bpe_codec.codec(tokenizer("word_bpe_49k.json")).lib
    want = []
    for r in rows:
        ids = lib.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_classifier_stage_learns_from_the_whole_table(spark, sf):
    big = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]  # no training row among them
    docs = spark.read.parquet(f"{big}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs.where(docs.doc_id.isin(held)), big).collect()}
    bad = {i for i in held if labels[i] == 0}
    good = set(held) - bad
    assert len(bad) > 4 and len(bad & kept) <= 0.1 * len(bad) and len(good & kept) >= 0.97 * len(good)


def test_run_and_empty_input(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert 0 < corpus_pipeline.run(spark, sf).count() < 200


def test_near_duplicates_without_ids(spark, sf):
    near = [" ".join(f"{a}{i}" for i in range(60)) + f" end{j}" for a in "xy" for j in range(3)]
    rows = [(None, near[0]), (None, near[0]), (None, near[1]), (5, near[3]), (None, near[4]), (7, near[3]), (5, near[3]), (9, ""), (9, ""), (None, None), (10, "alone here")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], schema).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got if r.text not in near) == sorted([(9, ""), (9, ""), (0, ""), (10, "alone here")])
    linked = [r for r in got if r.text in near]
    assert len(linked) == 2 and [r.doc_id for r in linked if r.text in near[3:]] == [5]
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), sf).count() == 0
