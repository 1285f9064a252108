"""A training-corpus pipeline: toxicity, near-dedup, decontamination, secret redaction, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of ``documents``; the last returns doc_id and sampled segmentations.

Defined cases, for every stage: null texts count as empty and stay null; rows with a null doc_id are judged by their texts where a stage
judges single rows (toxicity, secrets, pieces) and stay where it judges by id (near-dedup, decontamination); rows that share a doc_id
are one document there and go or stay together; an empty table gives an empty one; columns besides those of ``documents`` go through
unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlake.llm import decontamination, minhash_dedup, sampled_pieces, secrets, toxicity
from erlake.llm.common import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id."""
    return minhash_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text (and stays where that is null)."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's distinct sampled segmentations."""
    return sampled_pieces.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: Votes, minhash samples and sampled segmentations have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
