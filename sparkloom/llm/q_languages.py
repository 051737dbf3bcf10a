"""op8: language identification over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.language_id import language_id
from sparkloom.session import table


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
