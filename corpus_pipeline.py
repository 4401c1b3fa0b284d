"""Corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read back as the next stage's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm.common import drop, read, written
from auditlens.llm.decontamination import drop_contaminated
from auditlens.llm.jaccard_join import keep_one_per_group
from auditlens.llm.line_quality import keep_documents
from auditlens.llm.packing import pack_documents
from auditlens.llm.pii import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line CRF keep; the CRF learns from the labelled rows of ``documents``."""
    return keep_documents(docs, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (least doc_id) of each group linked by five-gram Jaccard similarity."""
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed spans replaced by their kind; n_chars follows the new text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of several permitted lengths: doc_id, piece, start, n_tokens, bin, capacity, offset."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The CRF verdict, the tokenizer and best fit cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; every stage's result is a written table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return docs
