"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept.  Stages hand on Parquet in the shared folder, so a lost executor
costs at most the stage it was in; a stage's table is deleted when the next one is written.

Null and empty texts fail the quality rules, so no later stage sees them; a null id passes (it is in no class of
near-duplicates and is packed with a null id); rows that repeat become one in the near-duplicates stage; texts
of any length stay whole; an empty table gives an empty result of the last stage's columns; extra columns pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.language_id import language_filter
from sparkloom.llm.order_minhash import near_duplicate_filter
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.quality_rules import quality_filter
from sparkloom.llm.secret_scan import redact_secrets
from sparkloom.session import discard, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules; null and empty texts do not."""
    return quality_filter(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the languages that the rows' own labels teach; without labels there is none, and no row stays."""
    return language_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates; equal rows are one class, rows without an id all stay."""
    return near_duplicate_filter(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with credentials in their texts replaced; a null text stays null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their token ids; an empty text is its end id alone."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("language_id", languages), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("packing", packing)]

#: The learnt language model and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return docs
