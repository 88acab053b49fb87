"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from textflow.llm import conversation_trie, licenses, line_dedup, periodic_runs, secrets
from textflow.llm.byte_bpe import digests
from textflow.llm.embedding_dups import vector_links
from textflow.llm.ngram_join import ngram_components
from textflow.llm.packing import packed
from textflow.llm.quality_mil import quality_scores
from textflow.llm.quality_rules import weak_quality
from textflow.llm.token_files import round_trip
from textflow.llm.toxicity_ssk import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have Jaccard >= 0.85."""
    return ngram_components(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a subsequence-kernel machine."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    return digests(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 1024 tokens."""
    return packed(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), end_id=2, room=1024)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, votes and posterior quality of every document."""
    return weak_quality(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as read back from the written token files."""
    return round_trip(_table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"), end_id=1)


def op8_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.93."""
    return vector_links(_table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or written out in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all branched conversations."""
    return conversation_trie.report(_table(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents or more share."""
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, and the text without their repetitions."""
    return periodic_runs.report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_ngram_jaccard_join, op3_toxicity, op4_byte_bpe, op5_best_fit_packing,
    op6_quality_rules, op7_token_files, op8_embedding_near_dups, op9_secret_scan, op10_license_scan,
    op11_conversation_trie, op12_line_dedup, op13_periodic_runs)}

SQL: dict[str, str] = {"op9_secret_scan": secrets.report_sql(), "op10_license_scan": licenses.scan_sql(),
                       "op11_conversation_trie": conversation_trie.report_sql(), "op12_line_dedup": line_dedup.report_sql()}
