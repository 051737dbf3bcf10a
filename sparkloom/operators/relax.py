"""Minimum relaxation: breadth-first search, shortest paths and component labels.

One superstep: vertices whose value improved (or all) send a value along their arcs; what is smaller than
what its receiver has becomes the next frontier.  Only the frontier is written, with its size as
a metric of the write: one job a step.  The state is the union of the frontiers so far, of which a vertex has its least
value; every ``MERGE`` steps they become one table.  A graph that is counted to be small is solved in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.arith import UNREACHED
from sparkloom.graph import Graph
from sparkloom.operators.components import connected_components
from sparkloom.plans import local
from sparkloom.plans.fixpoint import Run, slots, written
from sparkloom.plans.styles import LISTS, Style, laid_out, legal
from sparkloom.session import discard, materialize

Message = Callable[[Column, Column], Column]
#: Frontiers that make up the state before they are merged.
MERGE = 8
MAX_ROUNDS = 100_000


def _arcs(g: Graph, style: Style, weighted: bool) -> DataFrame:
    """Arcs (at, to, w), from the vertex whose value travels, as the style lays them out.

    Push partitions them by the end that sends, so frontiers move to them; pull by the end that receives,
    so that messages of a vertex are made where they are combined.
    """
    w = F.col("weight") if weighted else F.lit(1).cast("long")
    arcs = g.edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), w.alias("w"))
    key = "at" if style.flow == "push" else "to"
    if style.granularity == "vertex":  # a hub's arcs are many lists of a bounded size
        degree = arcs.groupBy("at").agg(F.count("*").alias("d")).withColumn("lists", F.ceil(F.col("d") / LISTS[style.unit]))
        cut = arcs.join(degree.select("at", "lists"), "at").withColumn("list", F.pmod(F.xxhash64("to"), F.col("lists")))
        arcs = cut.groupBy("at", "list").agg(F.collect_list(F.struct("to", "w")).alias("out")).select("at", "out")
        key = "at"
    arcs = laid_out(arcs, key, style, slots(arcs, g.edges.count()))
    return materialize(arcs, "arcs") if style.schedule == "nonpersist" else arcs.persist()


def _least(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables).groupBy("id").agg(F.min("value").alias("value"))


def relax(g: Graph, start: DataFrame, message: Message, algorithm: str, style: Style, weighted: bool = False) -> Run:
    """Fixpoint of (id, value) from ``start`` under ``message(value, weight)``."""
    if not legal(algorithm, style):
        raise ValueError(f"{algorithm} has no style {style.name}")
    arcs = _arcs(g, style, weighted)
    front, size = written(start, algorithm, F.count("*"))
    tables, rounds = [front], 0
    while size:
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"no fixpoint in {MAX_ROUNDS} rounds")
        active = front
        if style.drive == "topo":  # all vertices are looked at; in a search by levels those of the last one send
            active = _least(tables).where(F.col("value") == rounds) if algorithm == "bfs" else _least(tables)
        sent = active.select(F.col("id").alias("at"), "value").join(arcs, "at")
        if style.granularity == "vertex":
            sent = sent.select("value", F.inline("out"))
        sent = sent.select(F.col("to").alias("id"), message(F.col("value"), F.col("w")).alias("new"))
        if style.update == "rmw":  # messages are combined, then compared
            sent = sent.distinct() if style.worklist == "dup" else sent.groupBy("id").agg(F.min("new").alias("new"))
        known = _least(tables) if len(tables) > 1 else tables[0]
        better = sent.join(known, "id", "left").where("value IS NULL OR new < value").select("id", F.col("new").alias("value"))
        if style.update == "rw":  # messages were compared one by one
            better = better.distinct() if style.worklist == "dup" else better.groupBy("id").agg(F.min("value").alias("value"))
        front, size = written(better, algorithm, F.count("*"))
        rounds += 1
        if size:
            tables.append(front)
        if len(tables) > MERGE:
            merged = materialize(_least(tables), algorithm)
            for t in tables[:-1]:
                discard(t)
            tables = [merged, front]
    discard(arcs) if style.schedule == "nonpersist" else arcs.unpersist()
    return Run(_least(tables), rounds)


def _from_source(g: Graph, source: int) -> DataFrame:
    if not 0 <= source < g.n:
        raise ValueError(f"source {source} is not in 0..{g.n - 1}")
    return g.spark.range(source, source + 1).select("id", F.lit(0).cast("long").alias("value"))


def _all_vertices(g: Graph, run: Run, column: str) -> DataFrame:
    return g.vertices.join(run.state.select("id", F.col("value").alias(column)), "id", "left")


def bfs(g: Graph, source: int = 0, style: Style | None = None) -> DataFrame:
    """(id, dist): hops along arcs from the source, null where there is no path.

    Without a style a small graph is solved in one task and a large one in the default style.
    """
    start = _from_source(g, source)
    if style is None and local.fits(g):
        return local.in_one_task(g, ("src", "dst"), lambda n, src, dst: [local.shortest(n, source, src, dst)], "id long, dist long")
    run = relax(g, start, lambda value, _: value + 1, "bfs", style or Style())
    return _all_vertices(g, run, "dist")


def sssp(g: Graph, source: int = 0, style: Style | None = None) -> DataFrame:
    """(id, dist): least total weight along arcs from the source, null where there is no path; style as in :func:`bfs`."""
    g, start = g.weighted(), _from_source(g, source)
    if style is None and local.fits(g):
        return local.in_one_task(g, ("src", "dst", "weight"), lambda n, src, dst, w: [local.shortest(n, source, src, dst, w)], "id long, dist long")
    run = relax(g, start, lambda value, w: value + w, "sssp", style or Style(), weighted=True)
    return _all_vertices(g, run, "dist")


def components(g: Graph, style: Style | None = None) -> DataFrame:
    """(id, label): the smallest id of each vertex's component, whatever the direction of arcs.

    Without a style a small graph is solved in one task and a large one by star contraction, whose rounds grow with the
    logarithm of the graph; with one, label propagation in that style, whose rounds grow with the diameter.
    """
    if style is None and local.fits(g):
        return local.in_one_task(g, ("src", "dst"), lambda n, src, dst: [local.least_labels(n, src, dst)], "id long, label long")
    if style is None:
        found = connected_components(g.edges)
        return g.vertices.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    start = g.vertices.select("id", F.col("id").alias("value"))
    return _all_vertices(g, relax(g.undirected(), start, lambda value, _: value, "cc", style), "label")


def farthest(distances: DataFrame, sentinel: bool = False) -> DataFrame:
    """The vertex at the greatest distance, the lowest id of several.

    With ``sentinel``, unreached vertices count as 2147483647, as a fixed-width run would print.
    """
    d = F.coalesce("dist", F.lit(UNREACHED).cast("long")) if sentinel else F.col("dist")
    best = distances.select("id", d.alias("dist")).where("dist IS NOT NULL").agg(F.max(F.struct("dist", (-F.col("id")).alias("neg"))).alias("m"))
    return best.select((-F.col("m.neg")).alias("id"), F.col("m.dist").alias("dist"))
