"""Triangle counting: arcs oriented by degree, wedges closed by a join.

Orientation from the smaller to the larger (degree, id) bounds every vertex's
out-arcs by the square root of twice the arcs, so hubs make no wedge explosion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.plans.styles import Style, legal


def _oriented(g: Graph) -> DataFrame:
    """Each undirected edge once as (a, b), from the smaller to the larger (degree, id)."""
    g = g.undirected().drop_self_loops()
    degree = g.edges.groupBy("src").agg(F.count("*").alias("d"))
    one = degree.select("src", F.struct("d", "src").alias("src_rank"))
    two = degree.select(F.col("src").alias("dst"), F.struct("d", F.col("src").alias("src")).alias("dst_rank"))
    return g.edges.select("src", "dst").join(one, "src").join(two, "dst").where("src_rank < dst_rank").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def triangle_list(g: Graph, style: Style = Style()) -> DataFrame:
    """(a, b, c): each triangle once, whatever the direction of arcs.

    Edge style: wedges of two out-arcs of a vertex, closed by a join with the arcs.
    Vertex style: out-neighbour arrays of both ends of an arc, intersected.
    """
    if not legal("tc", style):
        raise ValueError(f"tc has no style {style.name}")
    arcs = _oriented(g)
    if style.granularity == "edge":
        wedge = arcs.join(arcs.withColumnRenamed("b", "c"), "a").where("b < c")
        closing = arcs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
        return wedge.join(closing, ["b", "c"]).select("a", "b", "c")
    out = arcs.groupBy("a").agg(F.collect_set("b").alias("out"))
    both = arcs.join(out, "a").join(out.select(F.col("a").alias("b"), F.col("out").alias("out_b")), "b")
    return both.select("a", "b", F.explode(F.array_intersect("out", "out_b")).alias("c"))


def triangles(g: Graph, style: Style = Style()) -> DataFrame:
    """The number of triangles; the reduction of the style says how partial sums meet."""
    found = triangle_list(g, style)
    if style.reduction == "global":  # a metric of the job that finds them
        seen = Observation()
        found.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
        return g.spark.range(1).select(F.lit(seen.get.get("n", 0)).cast("long").alias("triangles"))
    if style.reduction == "block":  # one sum per partition, then their sum
        parts = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
        return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))
    return found.agg(F.count("*").alias("triangles"))


def triangles_per_vertex(g: Graph, style: Style = Style()) -> DataFrame:
    """(id, triangles) of every vertex."""
    corners = triangle_list(g, style).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return g.vertices.join(corners, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))
