"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, secrets, source mixture.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of documents; the
last adds copy and shuffle_key, which name a copy of a document and its place in the global order. A stage's table is removed
when the one after it is written.

Defined results: null and empty texts are scored, linked and sampled like any other (the classifier decides whether they stay);
rows without an id take part, and of a class of near-duplicates one row stays whatever its id; repeated rows are
near-duplicates; ties go as the operators say; an empty table gives an empty result; columns of any name are kept, and where
one is named copy or shuffle_key, the last stage's own gets an underscore at its end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, quality, secret_scan, simhash
from tidemark.llm.common import discard, shared_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash class."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in the place of each secret."""
    return secret_scan.redact(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by source weights, in a global random order."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", source_mixture),
]

#: A fitted classifier and 64-bit fingerprints are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            discard(spark, f"{base}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
