"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import held_out, scored, train

    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import encoded_documents

    return encoded_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op5_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_store import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfair_mix import scheduled

    return scheduled(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import joined

    return joined(table(spark, sf_dir, "documents"), k=5, percent=80).withColumnRenamed("id", "doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    out = shard_rows(table(spark, sf_dir, "documents"), shards=24)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    return judged(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import digests, periodic_runs, planted

    return digests(periodic_runs(planted(table(spark, sf_dir, "documents")), "id", "text")).withColumnRenamed("id", "doc_id")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fit_packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_knn, op2_topk_search, op3_license_scan, op4_bpe_codec, op5_warc_store, op6_pfair_mix, op7_jaccard_join, op8_sharding, op9_quality_rules, op10_token_counts,
        op11_periodic_runs, op12_source_divergence, op13_fit_packing,
    )
}


def _license_sql() -> str:
    from .license_scan import oracle

    return oracle()


def _divergence_sql() -> str:
    from .source_divergence import ORACLE

    return ORACLE


#: Squared sums and hashes of floats aside, these are what SQL can say; the other queries have brute-force tests.
SQL: dict[str, str] = {
    "op2_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
""",
    "op3_license_scan": _license_sql(),
    "op12_source_divergence": _divergence_sql(),
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, r.root) AS component_id, coalesce(l.k, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a, min(b) AS root FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) l ON l.a = d.doc_id
""",
    "op5_warc_store": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS original FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original = page_id THEN NULL ELSE original END AS refers_to
FROM r
""",
}
