"""From raw documents to tokens: rules, classifier, near-duplicate removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is
written and read again for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import ROW_KEY, keyed, scratch, sized_join, without, written
from tidemark.llm.bpe_codec import encoded_documents
from tidemark.llm.jaccard_join import joined
from tidemark.llm.pfair_mix import mixed
from tidemark.llm.quality_knn import scored, train
from tidemark.llm.quality_rules import judged
from tidemark.llm.queries import table, tokenizer

LEAST_SCORE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail the base rules or are robust outliers of their language and source."""
    rows = keyed(docs)
    return without(rows, judged(rows, carry=tuple(ROW_KEY)).where("not kept"), "failed_rules")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score below LEAST_SCORE. The model learns from the labelled ones of the whole table of
    ``sf_dir``, since earlier stages leave too few bad ones to learn from."""
    rows = keyed(docs)
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    got = scored(rows, model, carry=tuple(ROW_KEY))
    return without(rows, got.where(F.col("score") < LEAST_SCORE), "low_scores")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id, of documents without ids or with equal ones that
    with the smallest row key, of repeated rows one. Documents without words link with nothing and all stay."""
    rows = keyed(docs)
    got = written(joined(rows, carry=tuple(ROW_KEY), component=True).where("component is not null"), "linked")
    per_row = got.groupBy("component", "id", *ROW_KEY).agg(F.count(F.lit(1)).alias("n"))  # copies of one row are one
    kept = per_row.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", *ROW_KEY)).alias("first")).select("first.*")
    others = written(per_row.select(*ROW_KEY).join(kept.select(*ROW_KEY), ROW_KEY, "left_anti"), "near_duplicates")
    again = written(per_row.where("n > 1").select(*ROW_KEY).join(kept.select(*ROW_KEY), ROW_KEY, "left_semi"), "repeated")
    out = sized_join(rows, others, ROW_KEY, "left_anti")
    if not again.isEmpty():  # only rows that repeat are compared as wholes
        out = sized_join(out, again, ROW_KEY, "left_anti").unionByName(sized_join(out, again, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY))
    return out.drop(*ROW_KEY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left."""
    return encoded_documents(docs, tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("ngram_jaccard_join", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: The stages' methods (robust scatter, latent-semantic votes) can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
