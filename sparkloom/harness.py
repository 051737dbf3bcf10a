"""The measuring harness: algorithms by graphs by styles, median of three, giga-edges per second."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from sparkloom.graph import Graph
from sparkloom.operators import independent_set, rank, relax, triangles, verify
from sparkloom.plans.styles import Style

SCHEMA = "algorithm string, graph string, style string, vertices long, arcs long, seconds double, gigaedges_per_s double, violations long"
RUNS = 3


def throughput(arcs: int, seconds: float) -> float:
    """Giga-edges per second."""
    return 1e-9 * arcs / seconds if seconds > 0 else 0.0


def algorithms(source: int = 0) -> dict[str, tuple[Callable, Callable | None]]:
    """Per algorithm: how to run it on (graph, style), and how to check the result."""
    return {
        "bfs": (lambda g, s: relax.bfs(g, source, s), lambda g, r: verify.verify_distances(g, r, source)),
        "sssp": (lambda g, s: relax.sssp(g, source, s), lambda g, r: verify.verify_distances(g, r, source, weighted=True)),
        "cc": (relax.components, verify.verify_components),
        "mis": (independent_set.independent_set, verify.verify_independent_set),
        "pr": (lambda g, s: rank.pagerank(g, style=s), None),
        "tc": (triangles.triangles, None),
    }


def measure(spark: SparkSession, graphs: dict[str, Graph], chosen: Iterable[tuple[str, Style]], runs: int = RUNS, check: bool = False, source: int = 0) -> DataFrame:
    """One row per graph, algorithm and style.  Loading and checking are not timed; the first run warms up."""
    rows = []
    known = algorithms(source)
    chosen = list(chosen)
    for graph_name, g in graphs.items():
        g = g.weighted().prepared()
        arcs = g.edges.count()
        for algorithm, style in chosen:
            run, checker = known[algorithm]
            taken, result = [], None
            for _ in range(runs):
                began = time.perf_counter()
                result = run(g, style)
                result.write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - began)
            bad = sum(r["violations"] for r in checker(g, result).collect()) if check and checker else None
            seconds = median(taken)
            rows.append((algorithm, graph_name, style.name, g.n, arcs, seconds, throughput(arcs, seconds), bad))
    return spark.createDataFrame(rows, SCHEMA)
