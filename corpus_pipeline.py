"""The corpus pipeline: quality rules, near-dedup, decontamination, PII and SentencePiece, in this order.

Every stage takes all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import common, decontaminate, pieces, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that fail the base rules or their group's adaptive limits."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each SimHash component, that of the least doc_id. Five-word shingles; seven bits are as far as
    fingerprints of 64 bits tell near copies from unrelated texts."""
    return simhash.keep_first(docs, shingle=5, radius=7)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a window of a benchmark item."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; n_chars follows the text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the best segmentation, and the scores and ids of the four best."""
    return pieces.encode(docs, pieces.Model.load(pieces.MODEL_FILE), n=4).select("doc_id", "n_pieces", "ids", "nbest_scores", "nbest", "ids_sha256", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", sanitisation),
    ("sentencepiece", tokenisation),
]

#: Hashing, co-occurrence scores and lattices are beyond SQL; tests/llm hold each stage's rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What passes between them is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, name)
    return docs
