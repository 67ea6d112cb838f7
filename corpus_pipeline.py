"""A training corpus from raw documents, in five stages, each written as Parquet and read by the next.

Stages take and return tables with the columns of documents; the last one adds shard and slot. Every stage
works on all rows its predecessor kept. Rows are told apart by their content, so null ids and repeated rows pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepoint.llm import decontaminate, line_quality, mixing, near_dedup, ring
from tidepoint.llm.common import stored, table

ORACLE_SQL = None  # signatures and multipliers are no SQL; tests/llm/test_tables.py and test_round3.py compare stages and run()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that are too short, repetitive or lose too much text go."""
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for."""
    return mixing.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and their place in it."""
    return ring.assign(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
