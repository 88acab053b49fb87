"""The training-data pipeline: stages over ``documents``, each reading what the
one before it kept."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textflow.llm import secrets
from textflow.llm.ngram_join import ngram_components
from textflow.llm.packing import packed
from textflow.llm.quality_mil import quality_scores
from textflow.llm.stored import store
from textflow.llm.toxicity_ssk import toxicity_scores


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, each judged by its own text, with an id or without."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole=True)
    return scores.where("predicted = 1").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic, each judged by its own text."""
    scores = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole=True)
    return scores.where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (5 words, Jaccard >= 0.8): the one with the smallest id.

    Rows are told apart by a key written beside them, so rows that repeat an id
    leave only for texts that are near.  A row without an id stays only where
    none of its group has one, the first of them by key."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    rows = store(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), "keyed")
    found = ngram_components(rows.select("key", F.col("row.text").alias("text")), "key", "text", words=5, num=8, den=10)
    groups = found.join(rows.select("key", F.col("row.doc_id").alias("doc_id")), "key")
    stay = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key")).alias("one"))
    return rows.join(stay.select("one.key"), "key", "left_semi").select(kept)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packed(docs, tokenizers.path("byte_bpe_50k.json"), end_id=2, room=1024)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned stages have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
