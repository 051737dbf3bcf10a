"""op9: near-duplicates among ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.order_minhash import near_duplicates
from sparkloom.session import table


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
SQL: dict[str, str] = {}
