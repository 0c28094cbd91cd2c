"""Registered queries of the subpackage: each runs its operator over a whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendero.llm import (conversation_repair, decontamination, lm_scoring, near_duplicates, quality_classifier, quality_rules,
                         ranked_search, scaled_sketch, secrets, sentencepiece_bpe, sharding, substring_dedup, token_files)
from tendero.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to seekable files and read back from them."""
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder, digest=True)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every text with the forest's verdict; values as digests."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "number", "start", F.col("size").cast("int").alias("length"),
                        F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) whose question and answer stand in one passage."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return sentencepiece_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and robust outlier verdict of every document."""
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards, with its slot and its shard of nine."""
    return sharding.numbered(_table(spark, sf_dir, "documents"), 8)


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that another document holds too."""
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document beside its exact unigram score."""
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))


def op10_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under the links of 85 % equal three-word shingles."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), width=3, similarity="0.85", bands=25, band=5)


def op11_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, its cheapest edits and a digest of the repaired rows."""
    return conversation_repair.repaired_after_damage(_table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search.search(ranked_search.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how alike they are."""
    return scaled_sketch.fingerprints(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_secret_scan, op3_benchmark_decontamination, op4_sentencepiece, op5_robust_quality_rules,
    op6_quality_classifier, op7_rendezvous_shards, op8_compact_windows, op9_bloom_lm, op10_minhash_groups, op11_hirschberg_repair, op12_ranked_search,
    op13_scaled_sketch)}
SQL = {"op7_rendezvous_shards": sharding.numbered_sql(8), "op12_ranked_search": ranked_search.SQL}
