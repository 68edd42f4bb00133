"""From raw documents to packed sequences: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame, which is written
and read again before the next. All but the last return the columns of documents, also extra ones of any name.

Null or empty texts are documents without words: the classifier scores them by its bias, they are near-duplicates of each
other, are never contaminated and hold nothing to redact. Rows with null doc_id, and rows that repeat one, are judged by
their own text and stay unless that is rejected or contaminated. Of ties the smallest doc_id stays. An empty table gives
no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, packing, pii, quality, simhash
from .common import Workspace, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, alike in 0.8 or more of their shingles of five words, the document of least
    doc_id stays."""
    return simhash.one_of_each(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in texts by their kind."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
