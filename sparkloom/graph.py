"""The graph model: vertices, arcs and how to build, check and describe them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.arith import arc_weight
from sparkloom.session import discard, materialize, table


@dataclass(frozen=True)
class Graph:
    """Vertices are the ids 0 to n-1; ``edges`` holds arcs (src, dst) and perhaps ``weight``.

    An undirected edge is stored as two arcs.  ``directed`` is False only where that is known of all
    arcs; algorithms that are about undirected edges otherwise add the reverse arcs themselves.
    """

    edges: DataFrame
    n: int
    directed: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    def dedup(self) -> Graph:
        """One arc per (src, dst); of several weights the smallest."""
        if "weight" in self.edges.columns:
            return replace(self, edges=self.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
        return replace(self, edges=self.edges.select("src", "dst").distinct())

    def drop_self_loops(self) -> Graph:
        return replace(self, edges=self.edges.where("src <> dst"))

    def symmetrize(self) -> Graph:
        """Each arc and its reverse, once."""
        swap = {"src": "dst", "dst": "src"}
        back = self.edges.select(*[F.col(swap.get(c, c)).alias(c) for c in self.edges.columns])
        return replace(self, edges=self.edges.unionAll(back), directed=False).dedup()

    def undirected(self) -> Graph:
        """The graph itself if each arc is known to have its reverse, else with the reverse arcs."""
        return self.symmetrize() if self.directed else self

    def weighted(self) -> Graph:
        """Weights as they are, or generated from the ends of each arc."""
        if "weight" in self.edges.columns:
            return self
        return replace(self, edges=self.edges.withColumn("weight", arc_weight(F.col("src"), F.col("dst"), self.n)))

    def prepared(self) -> Graph:
        """Arcs written once to shared storage: every superstep reads them, none recomputes them."""
        return replace(self, edges=materialize(self.edges, "edges"))

    def free(self) -> None:
        """Delete what :meth:`prepared` wrote."""
        discard(self.edges)

    def adjacency(self) -> DataFrame:
        """(id, nbrs): the ascending neighbours of each vertex that has any."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))

    def degrees(self) -> DataFrame:
        """(id, degree) of all vertices, isolated ones with 0."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def degree_summary(self) -> DataFrame:
        d = F.col("degree")
        return self.degrees().agg(
            F.count("*").alias("vertices"), F.sum("degree").alias("arcs"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"),
            F.count_if(d == 0).alias("isolated"), (F.count_if(d >= 32) / F.count("*")).alias("share_32"), (F.count_if(d >= 512) / F.count("*")).alias("share_512"),
        )

    def violations(self) -> DataFrame:
        """Counts of what the algorithms cannot take: one row per check."""
        e = self.edges.select("src", "dst")
        bad = F.col("src").isNull() | F.col("dst").isNull() | (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= self.n)
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        counts = [
            ("out_of_range", e.where(bad)),
            ("self_loop", e.where("src = dst")),
            ("duplicate", e.groupBy("src", "dst").count().where("count > 1")),
            ("one_way", e.join(back, ["src", "dst"], "left_anti")),
        ]
        out = None
        for name, rows in counts:
            one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
            out = one if out is None else out.unionAll(one)
        return out


def from_edges(edges: DataFrame, n: int | None = None, src: str = "src", dst: str = "dst", weight: str | None = None) -> Graph:
    """A graph from an edge list; without ``n`` the largest id sets it."""
    columns = [F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")]
    if weight:
        columns.append(F.col(weight).cast("long").alias("weight"))
    arcs = edges.select(*columns)
    if n is None:
        top = arcs.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
        n = 0 if top is None else top + 1
    return Graph(arcs, n)


def from_adjacency(adjacency: DataFrame, n: int) -> Graph:
    """CSR rows (id, nbrs) to arcs."""
    return Graph(adjacency.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst")), n)


def copurchase(spark: SparkSession, sf_dir: str, least: int = 40) -> Graph:
    """Parts that stand in lines of one order, each with a quantity of ``least`` or more."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least).select("l_orderkey", "l_partkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    arcs = a.join(b, "l_orderkey").where("src <> dst").select("src", "dst").distinct()
    return Graph(arcs, table(spark, sf_dir, "part").count(), directed=False)


def line_order(spark: SparkSession, sf_dir: str, least: int = 40) -> Graph:
    """A directed graph: from each part to those in later lines of an order, both with a quantity of ``least`` or more."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least)
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("src"))
    b = lines.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_partkey").alias("dst"))
    arcs = a.join(b, "l_orderkey").where("i < j AND src <> dst").select("src", "dst").distinct()
    return Graph(arcs, table(spark, sf_dir, "part").count())


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """The two-sided graph of parts and their suppliers; supplier s is vertex parts + s."""
    n, m = table(spark, sf_dir, "part").count(), table(spark, sf_dir, "supplier").count()
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst")).distinct()
    return Graph(lines, n + m).symmetrize()
