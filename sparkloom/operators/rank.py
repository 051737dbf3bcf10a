"""PageRank by Jacobi iteration, without redistribution from vertices that have no arcs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.plans import local
from sparkloom.plans.fixpoint import slots, written
from sparkloom.plans.styles import Style, laid_out, legal
from sparkloom.session import discard, materialize

# Damping, tolerance of the L1 change, and the bound of rounds.
DAMPING = 0.85
TOLERANCE = 1e-4
MAX_ROUNDS = 100


def pagerank_rounds(g: Graph, damping: float = DAMPING, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, style: Style | None = None) -> tuple[DataFrame, int]:
    """(id, score) and the rounds executed; stops after the round whose change is below the tolerance.

    Without a style a small graph is solved in one task and a large one in the default style.
    """
    if style is None and local.fits(g):
        def solve(n: int, src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
            score, rounds = local.jacobi(n, src, dst, damping, tolerance, max_rounds)
            return [score, np.full(n, rounds)]

        found = materialize(local.in_one_task(g, ("src", "dst"), solve, "id long, score double, rounds long"), "ranks")
        return found.select("id", "score"), found.agg(F.max("rounds").alias("n")).first()["n"]
    style = style or Style()
    if not legal("pr", style):
        raise ValueError(f"pr has no style {style.name}")
    degree = g.edges.groupBy("src").agg(F.count("*").alias("degree"))
    # Push lays arcs out by the end that gives, pull by the end that receives.
    arcs = g.edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    arcs = laid_out(arcs, "at" if style.flow == "push" else "to", style, slots(arcs, g.edges.count()))
    arcs = materialize(arcs, "arcs") if style.schedule == "nonpersist" else arcs.persist()
    share = degree.select(F.col("src").alias("id"), "degree")
    state = materialize(g.vertices.join(share, "id", "left").select("id", "degree", F.lit(1.0 / max(g.n, 1)).alias("score"), F.lit(0.0).alias("change")), "ranks")
    rounds = 0
    while rounds < max_rounds and g.n:
        given = state.where("degree IS NOT NULL").select(F.col("id").alias("at"), (F.col("score") / F.col("degree")).alias("part"))
        incoming = given.join(arcs, "at").groupBy(F.col("to").alias("id")).agg(F.sum("part").alias("incoming"))
        new = F.lit((1 - damping) / g.n) + damping * F.coalesce("incoming", F.lit(0.0))
        after = state.join(incoming, "id", "left").select("id", "degree", new.alias("score"), F.abs(new - F.col("score")).alias("change"))
        after, change = summed(after, "change", style)
        discard(state)
        state, rounds = after, rounds + 1
        if change < tolerance:
            break
    discard(arcs) if style.schedule == "nonpersist" else arcs.unpersist()
    return state.select("id", "score"), rounds


def summed(df: DataFrame, column: str, style: Style) -> tuple[DataFrame, float]:
    """The rows as a table, and a sum over them, reduced as the style says."""
    if style.reduction == "global":  # a metric of the write
        return written(df, "ranks", F.sum(column))
    out = materialize(df, "ranks")
    parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(column).alias(column)) if style.reduction == "block" else out
    return out, parts.agg(F.sum(column).alias("s")).first()["s"] or 0.0


def pagerank(g: Graph, damping: float = DAMPING, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, style: Style | None = None) -> DataFrame:
    return pagerank_rounds(g, damping, tolerance, max_rounds, style)[0]


def residual(g: Graph, ranks: DataFrame, damping: float = DAMPING) -> DataFrame:
    """The L1 change that one more round would make."""
    degree = g.edges.groupBy("src").agg(F.count("*").alias("degree"))
    sent = ranks.join(degree, ranks["id"] == degree["src"]).select("src", (F.col("score") / F.col("degree")).alias("part")).join(g.edges, "src")
    incoming = sent.groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("incoming"))
    new = F.lit((1 - damping) / g.n) + damping * F.coalesce("incoming", F.lit(0.0))
    return ranks.join(incoming, "id", "left").agg(F.sum(F.abs(new - F.col("score"))).alias("residual"))
