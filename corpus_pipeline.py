"""A corpus pipeline of five stages over documents, each of which works on all that its predecessor kept.

Every stage takes and keeps any further columns, whatever their names, and gives an empty table for an empty one. Null texts
count as empty ones. Long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import exactdup, mixing, neardup, pieces, quality
from lexweave.llm.common import saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the cut; learns from the labelled rows among docs.

    Empty texts are scored like others. Without any labelled row all score 0.5 and stay. Rows of equal text share their score, so
    repeated rows stay or go together.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts (a null one only if no other row has its text).

    Of rows that repeat a doc_id and its text one stays; a doc_id with two texts keeps both.
    """
    return exactdup.drop_copies(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies: five-word shingles, a similarity of 0.8 or more.

    Texts without words and rows with a null doc_id are linked with nothing and stay.
    """
    return neardup.drop_near_copies(docs, 80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources reach their target weights.

    Texts without words go, as no mix takes them. A null source is a source of its own. Ties of a length are broken by a seeded
    hash of doc_id, so reruns agree.
    """
    return mixing.mixture(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes texts: the columns of documents but the text, and ids and n_tokens (both null for a null text), which replace columns so named."""
    return pieces.encode(docs).drop("text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("source mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: A fitted classifier and an iterative component search have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
