"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries: each has QUERIES and SQL.
MODULES = ("q_pieces", "q_rules", "q_licenses", "q_quality", "q_secrets", "q_urls", "q_top_k", "q_languages", "q_near", "q_packing")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"sparkloom.llm.{module}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
