"""Maximal independent set: greedy by hashed priority, in rounds.

The priority is a bijection of the id, so there are no ties and one result: the
set that a greedy pass in priority order gives, whatever the style.  Arcs point from the weaker to the stronger
end: who waits for whom.  Data-driven rounds keep a worklist, which shrinks: of vertices (vertex style) those
that are undecided, or of arcs (edge style) those whose weak end is undecided and whose strong end is not excluded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.arith import priorities, priority
from sparkloom.graph import Graph
from sparkloom.plans import local
from sparkloom.plans.fixpoint import written
from sparkloom.plans.styles import Style, legal
from sparkloom.session import discard, materialize

UNDECIDED, INCLUDED, EXCLUDED = 0, 1, 2
MAX_ROUNDS = 10_000


def _waits(g: Graph, signed: bool) -> DataFrame:
    """Arcs (weak, strong) between neighbours, each pair once."""
    rank = lambda v: F.struct(priority(F.col(v), signed), F.col(v))
    return g.undirected().edges.where("src <> dst").where(rank("src") < rank("dst")).select(F.col("src").alias("weak"), F.col("dst").alias("strong"))


def independent_set(g: Graph, style: Style | None = None, signed: bool = False) -> DataFrame:
    """(id, priority, status): 1 in the set, 2 a neighbour of it.

    Without a style a small graph is solved in one task and a large one in the default style.
    """
    schema = "id long, priority long, status byte"
    if style is None and local.fits(g):
        return local.in_one_task(g, ("src", "dst"), lambda n, src, dst: [priorities(n, signed), local.greedy_set(n, src, dst, priorities(n, signed))], schema)
    style = style or Style()
    if not legal("mis", style):
        raise ValueError(f"mis has no style {style.name}")
    waits = materialize(_waits(g, signed), "waits")
    state, left = written(g.vertices.select("id", F.lit(UNDECIDED).alias("status")), "mis", F.count("*"))
    rounds = 0
    while left:
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"no fixpoint in {MAX_ROUNDS} rounds")
        own, strong = waits, state.select(F.col("id").alias("strong"), F.col("status").alias("strong_status"))
        if style.granularity == "vertex":  # vertices look at their stronger neighbours, in data style only the undecided ones
            live = state.where(F.col("status") == UNDECIDED) if style.drive == "data" else state
            own = waits.join(live.select(F.col("id").alias("weak")), "weak", "left_semi")
        met = own.join(strong.where(F.col("strong_status") != EXCLUDED), "strong")
        seen = met.groupBy(F.col("weak").alias("id")).agg(F.bool_or(F.col("strong_status") == INCLUDED).alias("beaten"))
        judged = state.join(seen, "id", "left")
        wins = (F.col("status") == UNDECIDED) & F.col("beaten").isNull()
        if style.flow == "push":  # winners of this round exclude their weaker neighbours at once
            won = judged.where(wins).select(F.col("id").alias("strong"))
            hit = own.join(won, "strong", "left_semi").select(F.col("weak").alias("id")).distinct().withColumn("hit", F.lit(True))
            judged = judged.join(hit, "id", "left")
        else:
            judged = judged.withColumn("hit", F.lit(False))
        new = (
            F.when(F.col("status") != UNDECIDED, F.col("status"))
            .when(wins, INCLUDED)
            .when(F.coalesce("beaten", F.lit(False)) | F.coalesce("hit", F.lit(False)), EXCLUDED)
            .otherwise(UNDECIDED)
        )
        after, left = written(judged.select("id", new.alias("status")), "mis", F.count_if(F.col("status") == UNDECIDED))
        discard(state)
        state, rounds = after, rounds + 1
        if left and style.granularity == "edge" and style.drive == "data":
            weak = state.where(F.col("status") == UNDECIDED).select(F.col("id").alias("weak"))
            strong = state.where(F.col("status") != EXCLUDED).select(F.col("id").alias("strong"))
            fewer = materialize(waits.join(weak, "weak", "left_semi").join(strong, "strong", "left_semi").select("weak", "strong"), "waits")
            discard(waits)
            waits = fewer
    discard(waits)
    return state.select("id", priority(F.col("id"), signed).alias("priority"), F.col("status").cast("byte").alias("status"))


def set_size(status: DataFrame) -> DataFrame:
    """The number and percentage of included vertices."""
    n = F.count_if(F.col("status") == INCLUDED)
    return status.agg(n.alias("included"), F.round(100.0 * n / F.count("*"), 1).alias("percent"))
