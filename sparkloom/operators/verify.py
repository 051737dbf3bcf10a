"""Violation counts: a result is right if every row says 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.operators.independent_set import INCLUDED, UNDECIDED


def _counts(**rows: DataFrame) -> DataFrame:
    out = None
    for name, bad in rows.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionAll(one)
    return out


def verify_distances(g: Graph, result: DataFrame, source: int, weighted: bool = False) -> DataFrame:
    """The source is at 0, no arc can be relaxed, and every other reached vertex has a tight arc into it.

    With positive weights these three make the distances unique; a tight arc of weight 0 may come from an equal.
    """
    g = g.weighted() if weighted else g
    w = F.col("weight") if weighted else F.lit(1)
    near = result.select(F.col("id").alias("src"), F.col("dist").alias("a"))
    far = result.select(F.col("id").alias("dst"), F.col("dist").alias("b"))
    arcs = g.edges.join(near.where("a IS NOT NULL"), "src").join(far, "dst").withColumn("via", F.col("a") + w)
    tight = arcs.where("via = b").select(F.col("dst").alias("id"))
    reached = result.where(F.col("dist").isNotNull() & (F.col("id") != source))
    return _counts(
        source=result.where((F.col("id") == source) & ((F.col("dist") != 0) | F.col("dist").isNull())),
        relaxable=arcs.where("b IS NULL OR via < b"),
        unsupported=reached.join(tight, "id", "left_anti"),
        missing=g.vertices.join(result, "id", "left_anti"),
    )


def verify_components(g: Graph, result: DataFrame) -> DataFrame:
    """Ends of an arc agree, labels are members' ids, none is larger than its member, every label labels itself."""
    one, two = (result.select(F.col("id").alias(e), F.col("label").alias(f"{e}_label")) for e in ("src", "dst"))
    return _counts(
        split=g.edges.join(one, "src").join(two, "dst").where("src_label <> dst_label"),
        not_least=result.where("label IS NULL OR label > id"),
        no_root=result.select("label").distinct().join(result.where("label = id").select("label"), "label", "left_anti"),
        missing=g.vertices.join(result, "id", "left_anti"),
    )


def verify_independent_set(g: Graph, result: DataFrame) -> DataFrame:
    """All decided; no two neighbours included; every excluded vertex has an included neighbour."""
    inside = result.where(F.col("status") == INCLUDED)
    pairs = g.edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi")
    return _counts(
        undecided=result.where(F.col("status") == UNDECIDED),
        dependent=pairs.join(inside.select(F.col("id").alias("dst")), "dst", "left_semi"),
        not_maximal=result.where(F.col("status") != INCLUDED).join(pairs.select(F.col("dst").alias("id")), "id", "left_anti"),
        missing=g.vertices.join(result, "id", "left_anti"),
    )


def differences(result: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """Rows of either side that the other has not, or has otherwise."""
    values = [c for c in result.columns if c != key]
    a = result.select(key, F.struct(*values).alias("result"))
    b = expected.select(key, F.struct(*values).alias("expected"))
    return a.join(b, key, "full_outer").where(~F.col("result").eqNullSafe(F.col("expected")))
