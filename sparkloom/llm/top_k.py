"""Exact top-k by inner product: norm-sorted blocks with rotated partial sums.

Vectors are sorted by descending length into blocks.  A rotation from the
singular vectors of all vectors (the eigenvectors of their Gram matrix, which is
summed on the executors) moves most of every product into the first coordinates.
Beyond ``BASIS`` components the rotation turns runs of that many coordinates each by
itself: still a rotation, so bounds and results stay exact.
For a block, a query's products over the leading coordinates plus the
Cauchy-Schwarz bound of what is left, |rest of query| * |rest of vector|, bound
the scores from above; a query whose threshold is beyond |query| * |longest
vector| skips the block, and only pairs whose bound reaches the threshold are
scored exactly, in the original integers.

Queries come in blocks of a bounded number of bytes, read from a written table and broadcast
one at a time: a block's result is written and its broadcast freed before the next one, so the driver and the
tasks hold one block, however many queries there are.  A block of
queries first meets the longest vectors, which sets the thresholds; each task
then gives the rows that may still be among the best, at most k per query.

Defined results: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as padded with zeros; rows with one id are one
another's own and never each other's candidates; a repeated query id answers once, by
its first vector in sort order; repeated candidates with other ids all count; ties
go to the smaller id; an empty table, or one without queries, gives no rows; vectors of any number of components count whole; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import discard, materialize, shared_dir

K = 5
#: Queries broadcast at once and bytes of them at most, vectors of a block and bytes of them, leading coordinates' share.
QUERY_BLOCK = 4096
QUERY_BYTES = 16 << 20
BLOCK = 2048
BLOCK_BYTES = 32 << 20
LEAD = 0.5
#: Coordinates that are rotated together, and cells of all Gram matrices, at most.
BASIS = 512
GRAM = 1 << 22
#: The longest vectors, that set the thresholds; their bytes at most, and bytes of pairs that are scored at once.
HEAD = 4096
HEAD_BYTES = 16 << 20
PAIR_BYTES = 64 << 20


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size]) if len(size) else []] = flat
    return out


class Rotation:
    """Bases of runs of coordinates, and the coordinates after turning in order of their weight."""

    def __init__(self, bases: list[np.ndarray], weights: np.ndarray) -> None:
        self.bases, self.dim = bases, len(weights)
        order = np.argsort(-weights, kind="stable")
        lead = max(1, int(self.dim * LEAD))
        self.front, self.back = np.sort(order[:lead]), np.sort(order[lead:])

    def split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leading coordinates of turned vectors, and the lengths of what is left."""
        turned, at = np.empty_like(m), 0
        for basis in self.bases:
            turned[:, at : at + len(basis)] = m[:, at : at + len(basis)] @ basis
            at += len(basis)
        return turned[:, self.front], np.linalg.norm(turned[:, self.back], axis=1)


def rotation(vectors: DataFrame, dim: int) -> Rotation:
    """From the eigenvectors of the Gram matrix of each run of coordinates, GRAM cells in all at most."""
    width = max(1, min(BASIS, dim, GRAM // dim))
    runs = [(at, min(dim, at + width)) for at in range(0, dim, width)]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((b - a, b - a)) for a, b in runs]
        for part in blocks_of(batches, dim, 0):
            for total, (a, b) in zip(totals, runs, strict=True):
                total += part[:, a:b].T @ part[:, a:b]
        for total, (a, b) in zip(totals, runs, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(list(total))], names=["i", "row"])

    rows = vectors.select("v").mapInArrow(gram, "i long, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    i, j, x = (sums[c].to_numpy() for c in ("i", "j", "x"))
    bases, weights = [], np.zeros(dim)
    for a, b in runs:
        total, own = np.zeros((b - a, b - a)), (i >= a) & (i < b)
        total[i[own] - a, j[own]] = x[own]
        values, basis = np.linalg.eigh(total)
        weights[a:b] = values
        bases.append(np.ascontiguousarray(basis))
    return Rotation(bases, weights)


class Searcher:
    """Queries with their rotated parts, and the k best found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, basis: Rotation, k: int) -> None:
        self.ids, self.vectors, self.basis, self.k = ids, vectors, basis, k
        self.front, self.rest = basis.split(vectors)
        self.length = np.linalg.norm(vectors, axis=1)
        self.floor = np.full(len(ids), -np.inf)

    def search(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of candidates that may be among the best."""
        q, most = len(self.ids), max(1, PAIR_BYTES // (16 * self.basis.dim))
        rows, names, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for ids, vectors in blocks:
            length = np.linalg.norm(vectors, axis=1)
            # Floating-point slack: bounds may only err upwards.
            slack = 1e-9 * (1.0 + self.length * (length.max() if len(length) else 0.0))
            live = np.flatnonzero(self.length * (length.max() if len(length) else 0.0) + slack >= self.floor)
            if not len(live):
                continue
            front, rest = self.basis.split(vectors)
            bound = self.front[live] @ front.T + np.outer(self.rest[live], rest)
            a, b = np.nonzero((bound + slack[live, None] >= self.floor[live, None]) & (self.ids[live, None] != ids[None, :]))
            a = live[a]
            exact = np.empty(len(a))
            for i in range(0, len(a), most):
                exact[i : i + most] = np.einsum("ij,ij->i", self.vectors[a[i : i + most]], vectors[b[i : i + most]])
            good = exact >= self.floor[a]
            rows, names, scores = np.append(rows, a[good]), np.append(names, ids[b[good]]), np.append(scores, exact[good])
            order = np.lexsort((names, -scores, rows))
            rows, names, scores = rows[order], names[order], scores[order]
            first = np.searchsorted(rows, np.arange(q))
            place = np.arange(len(rows)) - first[rows]
            keep = place < self.k
            full = np.flatnonzero(place == self.k - 1)
            self.floor[rows[full]] = np.maximum(self.floor[rows[full]], scores[full])
            rows, names, scores = rows[keep], names[keep], scores[keep]
        return rows, names, scores


def blocks_of(batches: Iterator[pa.RecordBatch], dim: int, column: int = 1) -> Iterator:
    """Matrices of a bounded size, with the ids before them unless the vectors are the only column."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            m = _stack(part.column(column), dim)
            yield (part.column(0).to_numpy(zero_copy_only=False), m) if column else m


def top_k(df: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """For each id divisible by ``every``: its ``k`` best other rows by inner product."""
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    base = base.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # Longest first within each task, and whole ranges of length to a task: thresholds rise early, blocks are even.
    vectors = materialize(base.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id"), "vectors")
    dim = vectors.agg(F.max(F.size("v")).alias("dim")).first()["dim"] or 0
    schema = "query_id long, vec_id long, score double"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if dim == 0:
        discard(vectors)
        return empty
    basis = rotation(vectors, dim)
    size = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * dim)))
    queries = materialize(vectors.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    head = vectors.orderBy(F.desc("norm"), "id").limit(max(1, min(HEAD, HEAD_BYTES // (8 * dim)))).select("id", "v").toArrow()
    # Hash parts of the queries, each small enough to broadcast; twice as many as needed keep nearly all under the bound.
    parts = -(-queries.count() // size)
    parts = 1 if parts <= 1 else 2 * parts
    found = f"{shared_dir(spark)}/sparkloom/found-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(found)
    for part in range(parts):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id").toArrow()
        for at in range(0, own.num_rows, size):
            block = own.slice(at, size).combine_chunks()
            ids, m = block.column(0).to_numpy(), _stack(block.column(1).combine_chunks(), dim)
            searcher = Searcher(ids, m, basis, k)
            searcher.search(blocks_of(iter(head.to_batches()), dim))
            shared = spark.sparkContext.broadcast((ids, m, basis, searcher.floor))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, m, basis, floor = shared.value
                own = Searcher(ids, m, basis, k)
                own.floor = floor.copy()
                rows, names, scores = own.search(blocks_of(batches, dim))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(names), pa.array(scores)], names=["query_id", "vec_id", "score"])

            vectors.select("id", "v").mapInArrow(run, schema).write.mode("append").parquet(found)
            shared.destroy()
    discard(vectors)
    discard(queries)
    # Pairs are few: at most k a query and task, of which a task of the ranking keeps k a query.
    pairs = spark.read.schema(schema).parquet(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
