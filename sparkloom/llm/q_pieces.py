"""op1: SentencePiece encoding and decoding of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.sentence_pieces import encode_documents
from sparkloom.session import table


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).drop("ids", "nbest")


QUERIES = {"op1_sentence_pieces": op1_sentence_pieces}
SQL: dict[str, str] = {}
