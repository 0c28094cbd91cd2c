"""A training corpus from raw documents: five stages, each stored before the next reads it.

Every stage works on all rows that the one before kept and returns the columns of
``documents``; the last one returns the encoded corpus. Equal rows are treated alike; rows
without an id stay unless a stage's decision rests on the text alone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendero.llm import decontamination, near_duplicates, quality_classifier, secrets, sentencepiece_bpe
from tendero.session import checkpoint_dir

TOKENIZER = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.3)."""
    weights = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, weights, score_col="_quality_score")
    return scored.where("_quality_score >= 0.3").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    gone = near_duplicates.near_duplicates(docs, width=5, similarity="0.8").where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds a benchmark item's question and answer."""
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    hits = decontamination.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_text_key")
    gone = hits.select(F.col("doc_id").alias("_text_key")).distinct()
    return keyed.join(gone, "_text_key", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced; ``n_chars`` follows the new text."""
    clean = secrets.redact(docs, secrets.scan(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                 .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return sentencepiece_bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scan", redact_secrets),
    ("sentencepiece", encode),
]

# Trained scores, signatures and subword encoding have no SQL form: the tests hold the operators
# against brute force, and the stages against the columns and rows that they must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
