"""op10: packing of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.packing import pack_documents
from sparkloom.session import table


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
