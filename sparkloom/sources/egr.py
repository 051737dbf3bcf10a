"""Binary graph files: a Python data source that reads vertex ranges, and a writer.

Layout, 32-bit integers in native order: vertices, arcs, row offsets
(vertices + 1), neighbours (arcs), and perhaps weights (arcs).  A file that ends
after the neighbours has no weights; any other length is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sparkloom.graph import Graph
from sparkloom.session import discard, materialize

SCHEMA = "src long, dst long, weight long"
_INT = np.dtype("=i4")
_LEAST, _MOST = -(1 << 31), (1 << 31) - 1


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _ints(file, at: int, count: int) -> np.ndarray:
    """``count`` integers from integer position ``at``."""
    file.seek(4 * at)
    data = file.read(4 * count)
    if len(data) != 4 * count:
        raise ValueError("the graph file is cut short")
    return np.frombuffer(data, _INT)


def header(path: str) -> tuple[int, int, bool]:
    """Vertices, arcs, and whether there are weights."""
    system, name = _open(path)
    size = system.get_file_info(name).size
    with system.open_input_file(name) as file:
        n, m = (int(x) for x in _ints(file, 0, 2))
    if n < 1 or m < 0:
        raise ValueError(f"not a graph: {n} vertices, {m} arcs")
    plain = 4 * (2 + n + 1 + m)
    if size not in (plain, plain + 4 * m):
        raise ValueError(f"{size} bytes do not fit {n} vertices and {m} arcs")
    return n, m, m > 0 and size > plain


@dataclass
class VertexRange(InputPartition):
    low: int
    high: int


class EgrReader(DataSourceReader):
    def __init__(self, path: str, slices: int) -> None:
        self.path, self.slices = path, slices
        self.n, self.m, self.weights = header(path)

    def partitions(self) -> list[VertexRange]:
        """Vertex ranges with about equal numbers of arcs."""
        system, name = _open(self.path)
        bounds, k = [0], max(1, min(self.slices, self.n))
        with system.open_input_file(name) as file:
            for i in range(1, k):  # binary search in the offsets on disk
                low, high = bounds[-1], self.n
                while low < high:
                    mid = (low + high) // 2
                    if int(_ints(file, 2 + mid, 1)[0]) < i * self.m // k:
                        low = mid + 1
                    else:
                        high = mid
                bounds.append(low)
        bounds.append(self.n)
        return [VertexRange(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if a < b]

    def read(self, partition: VertexRange) -> Iterator[pa.RecordBatch]:
        system, name = _open(self.path)
        with system.open_input_file(name) as file:
            offsets = _ints(file, 2 + partition.low, partition.high - partition.low + 1).astype(np.int64)
            sources = np.repeat(np.arange(partition.low, partition.high), np.diff(offsets))
            first, step, base = int(offsets[0]), 1 << 20, 3 + self.n
            for at in range(0, len(sources), step):
                count = min(step, len(sources) - at)
                to = _ints(file, base + first + at, count).astype(np.int64)
                weight = pa.array(_ints(file, base + self.m + first + at, count).astype(np.int64)) if self.weights else pa.nulls(count, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(sources[at : at + count]), pa.array(to), weight], names=["src", "dst", "weight"])


class EgrSource(DataSource):
    """``spark.read.format("egr").load(path)``; option ``slices`` sets the number of partitions."""

    @classmethod
    def name(cls) -> str:
        return "egr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> EgrReader:
        return EgrReader(self.options["path"], int(self.options.get("slices", "8")))


def read_egr(spark: SparkSession, path: str, slices: int = 8, directed: bool = True) -> Graph:
    """A graph file as arcs; the weight column is left out if the file has none.

    A file does not say whether each arc has its reverse; ``directed=False`` says so.
    """
    spark.dataSource.register(EgrSource)
    n, _, weights = header(path)
    edges = spark.read.format("egr").option("slices", str(slices)).load(path)
    return Graph(edges if weights else edges.select("src", "dst"), n, directed)


def _chunks(df, column: str):
    """The column's 32-bit bytes, in the order of the rows, as rows of about a megabyte that tasks make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < _LEAST or values.max() > _MOST):
                raise ValueError(f"a {column} does not fit 32 bits")
            data = values.astype(_INT).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    return (r["data"] for r in df.select(F.col(column).cast("long")).mapInArrow(run, "data binary").toLocalIterator())


def write_egr(g: Graph, path: str) -> None:
    """One file: row offsets, then neighbours, then weights, in order of (src, dst).

    Tasks sort ranges and encode them; the driver streams their blocks into the file, one partition at a time.
    """
    system, name = _open(path)
    ordered = materialize(g.edges, "arcs")
    m = ordered.count()
    if max(g.n, m) > _MOST:
        raise ValueError(f"{g.n} vertices and {m} arcs do not fit 32 bits")
    columns = ["dst", "weight"] if "weight" in g.edges.columns else ["dst"]
    with system.open_output_stream(name) as out:
        out.write(np.array([g.n, m, 0], _INT).tobytes())
        total = 0
        for data in _chunks(g.degrees().orderBy("id"), "degree"):
            offsets = total + np.cumsum(np.frombuffer(data, _INT), dtype=np.int64)
            total = int(offsets[-1]) if len(offsets) else total
            out.write(offsets.astype(_INT).tobytes())
        for column in columns:
            for data in _chunks(ordered.orderBy("src", "dst"), column):
                out.write(data)
    discard(ordered)
