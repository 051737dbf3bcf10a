"""Supersteps: a plan per step, its result cut off from its lineage, and its counts from the write itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.session import materialize


@dataclass
class Run:
    """The final state and the number of supersteps."""

    state: DataFrame
    rounds: int


def written(df: DataFrame, label: str, value: Column) -> tuple[DataFrame, float]:
    """The rows as a table in shared storage, and an aggregate of them that the write observes."""
    seen = Observation()
    out = materialize(df.observe(seen, value.alias("value")), label)
    found = seen.get.get("value") if seen.get else None
    if found is None:  # nothing was written, or the metric got lost
        found = out.agg(value.alias("value")).first()["value"]
    return out, found or 0


def slots(df: DataFrame, rows: int) -> int:
    """Partitions for ``rows`` narrow rows: as many as there are cores, and more where a partition would be large."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 4_000_000))
