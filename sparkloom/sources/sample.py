"""A made-up result table, from a rule: names in the harness's form with known tags."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.results import GRAPHS

COLUMNS = ("filename", "throughput", "graph", "algorithm", "model", "granularity", "drive", "worklist", "flow", "update", "determinism", "persistence", "unit", "reduction", "schedule", "atomics")


def _processor_rows() -> list[dict]:
    out = []
    axes = (GRAPHS, ("BFS", "SSSP"), (("CPP", "Block"), ("CPP", "Cyclic"), ("OMP", "Default"), ("OMP", "Dynamic")), ("V", "E"), ("Topo", "Data"), ("Push", "Pull"), ("Determ", "NonDeterm"))
    for graph, algorithm, (model, schedule), gran, drive, flow, det in itertools.product(*axes):
        if gran == "E" and flow == "Pull":
            continue
        spelt = {"Push": "push", "Default": "DefaultSched"}
        name = f"_32_{graph}_{algorithm}_{model}_{gran}_{drive}_{spelt.get(flow, flow)}_IntType_{det}_NoFieldBug_{spelt.get(schedule, schedule)}_Atomic.cpp"
        out.append({"filename": name, "graph": graph, "algorithm": algorithm, "model": model, "granularity": gran, "drive": drive, "flow": flow, "determinism": det, "schedule": schedule, "atomics": "Atomic"})
    return out


def _worklist_rows() -> list[dict]:
    out = []
    for graph, dup, update, flow in itertools.product(("rmat", "ny"), ("Dup", "NonDup"), ("ReadWrite", "ReadModifyWrite"), ("Push", "Pull")):
        name = f"omp_32_{graph}_MIS_OMP_V_Data_{flow}_IntType_{update}_{dup}_Default.cpp"
        out.append({"filename": name, "graph": graph, "algorithm": "MIS", "model": "OMP", "granularity": "V", "drive": "Data", "worklist": dup, "flow": flow, "update": update, "schedule": "Default"})
    return out


def _graphics_rows() -> list[dict]:
    out = []
    axes = (("soc", "2d"), ("PR", "TC"), ("V", "E"), ("Persist", "NonPersist"), ("Thread", "Warp", "Block"), ("GlobalAdd", "BlockAdd", "Reduction"), ("Atomic", "CudaAtomic"))
    for graph, algorithm, gran, persistence, unit, reduction, atomics in itertools.product(*axes):
        name = f"{graph}_3090{algorithm}_{gran}_{unit}_{persistence}_{reduction}_IntType_{atomics}.cu"
        out.append({"filename": name, "graph": graph, "algorithm": algorithm, "model": "CUDA", "granularity": gran, "persistence": persistence, "unit": unit, "reduction": reduction, "atomics": atomics})
    return out


def sample_rows() -> list[tuple]:
    """Rows of COLUMNS; throughputs follow a rule, some are 0, some names end in a line end."""
    out = []
    for k, row in enumerate([*_processor_rows(), *_worklist_rows(), *_graphics_rows()]):
        row = row | {"filename": row["filename"] + "\n" * (k % 5 == 0), "throughput": 0.0 if k % 97 == 5 else ((k * 37) % 101 + 1) / 8}
        out.append(tuple(row.get(c) for c in COLUMNS))
    return out


def sample_results(spark: SparkSession) -> DataFrame:
    """(filename, throughput, pos), as a result CSV would give them, with their place in it."""
    return spark.createDataFrame([(*r[:2], k) for k, r in enumerate(sample_rows())], "filename string, throughput double, pos long")


#: A log of two programs with a value and one without between them.
SAMPLE_LOG = (
    "compile : alpha_CPP.cpp",
    "nodes: 7",
    "Throughput: 1.5 gigaedges/s",
    "compile : beta_CPP.cpp",
    "verification failed",
    "compile : gamma_CPP.cpp",
    "Throughput: 2.25 gigaedges/s",
)
