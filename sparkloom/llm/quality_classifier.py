"""Quality classifier: a factorisation machine over words, structure and metadata.

A text is a sparse vector: hashed distinct words, bins of structure statistics
(lengths, shares of symbols, capitals, digits, repeats, lines) and of metadata
(the stated number of characters).  Its score is linear in the non-zeros: the
pairwise term of rank r is half the sum over factors of (sum v x)^2 - sum (v x)^2.

Learning takes at most ``SAMPLE`` labelled texts outside the held-out fold, chosen
by a hash of the id; features are made on the executors and the sample's sparse
rows are fitted on the driver.  Learning and scoring alike read whole texts with every
distinct hashed word.  A row has at most ``FEATURES`` non-zeros of 8 bytes, so the driver's memory is
bounded by the sample; the model has a fixed size.

Defined results: a null text counts as empty; without labelled rows of both kinds
the score is the share of label 1 (0.5 without any); repeated labels of an id are
averaged; repeated rows are scored alike; other columns (labels, language, source and
id included) never enter a score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._rows import held_out
from sparkloom.llm._words import word_hashes

#: Hash buckets of words, bins of a statistic, factors, labelled texts to learn from at most.
BUCKETS = 1 << 15
BINS = 32
RANK = 8
SAMPLE = 8_000
EPOCHS = 12
BATCH = 128
RATE = 0.02
DECAY = 1e-5

_KIND = np.zeros(256, np.int8)
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KIND[[ord(c) for c in "0123456789"]] = 3
_KIND[[ord(c) for c in " \t\n\r\x0b\x0c"]] = 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
_KIND[[ord(c) for c in "#*$%&|<>~^_=+\\/@[]{}!"]] = 6
_KIND[128:] = 7
STATISTICS = ("bytes", "words", "word_bytes", "capitals", "digits", "spaces", "stops", "symbols", "distinct", "lines", "line_bytes", "line_repeats", "stated")
FEATURES = BUCKETS + BINS * len(STATISTICS)


def _share_bin(x: float) -> int:
    """Bins of a share: fine near 0, where texts differ most."""
    return min(BINS - 1, int(BINS * min(1.0, max(0.0, x)) ** 0.5))


def _size_bin(x: float) -> int:
    return min(BINS - 1, int(2 * np.log2(1 + max(0.0, x))))


def features(text: str | None, stated: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's sparse vector."""
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(_KIND[data], minlength=8) / n
    words = word_hashes(text)
    distinct = np.unique(words & np.uint64(BUCKETS - 1))
    lines = text.split("\n")
    numbers = (
        _size_bin(len(data)),
        _size_bin(len(words)),
        _size_bin(len(data) / max(1, len(words))),
        *(_share_bin(kinds[k]) for k in (2, 3, 4, 5, 6)),
        _share_bin((len(np.unique(words)) / len(words)) ** 2 if len(words) else 0.0),
        _size_bin(len(lines)),
        _size_bin(n / len(lines)),
        _share_bin(1 - len(set(lines)) / len(lines)),
        BINS - 1 if stated is None else min(BINS - 2, _size_bin(stated)),
    )
    index = np.concatenate([distinct.astype(np.int64), BUCKETS + BINS * np.arange(len(STATISTICS)) + np.array(numbers)])
    value = np.ones(len(index))
    value[: len(distinct)] = 1 / np.sqrt(max(1, len(distinct)))
    return index, value


@dataclass(frozen=True)
class Model:
    """Bias, linear weights and factors; ``flat`` is the score where nothing was learnt."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    flat: float | None = None

    def score(self, text: str | None, stated: float | None) -> float:
        if self.flat is not None:
            return self.flat
        index, value = features(text, stated)
        part = self.factors[index] * value[:, None]
        pairs = 0.5 * float((part.sum(0) ** 2 - (part**2).sum(0)).sum())
        margin = self.bias + float(self.linear[index] @ value) + pairs
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], seed: int = 7) -> Model:
    """Adam on the logistic loss over sparse rows."""
    labels = np.array([y for _, _, y in rows])
    if not len(labels) or labels.min() == labels.max():
        return Model(0.0, np.zeros(0), np.zeros((0, RANK)), float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    # One table of parameters: the linear weight and the factors of each feature, then the bias row.
    theta = np.zeros((FEATURES + 1, RANK + 1))
    theta[:FEATURES, 1:] = rng.normal(0, 0.02, (FEATURES, RANK))
    share = labels.mean()
    theta[FEATURES, 0] = np.log(share / (1 - share))
    first, second, t = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            index, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            size = np.array([len(r[0]) for r in part])
            start, owner = np.cumsum(size) - size, np.repeat(np.arange(len(part)), size)
            x = theta[index] * value[:, None]
            sums = np.add.reduceat(x, start)
            squares = np.add.reduceat(x[:, 1:] ** 2, start).sum(1)
            margin = theta[FEATURES, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - np.array([r[2] for r in part])) / len(part)
            step = np.empty_like(x)
            step[:, 0] = value
            step[:, 1:] = value[:, None] * (sums[owner, 1:] - x[:, 1:])
            step *= error[owner, None]
            touched, place = np.unique(index, return_inverse=True)
            grad = np.stack([np.bincount(place, step[:, k], len(touched)) for k in range(RANK + 1)], axis=1) + DECAY * theta[touched]
            touched = np.append(touched, FEATURES)
            grad = np.vstack([grad, np.append(error.sum(), np.zeros(RANK))])
            t += 1
            first[touched] = 0.9 * first[touched] + 0.1 * grad
            second[touched] = 0.999 * second[touched] + 0.001 * grad**2
            rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            theta[touched] -= rate * first[touched] / (np.sqrt(second[touched]) + 1e-8)
    return Model(float(theta[FEATURES, 0]), theta[:FEATURES, 0].copy(), theta[:FEATURES, 1:].copy())


def _stated(df: DataFrame, chars_col: str):
    return F.col(chars_col).cast("double") if chars_col in df.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", chars_col: str = "n_chars", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows of the learning fold, ``sample`` of them at most (in expectation; never more than 1.25 times that)."""
    learn = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("id")))
    learn = learn.groupBy("id").agg(F.avg("y").alias("y"))
    n = learn.count()
    if n > sample:
        learn = learn.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1_000_000)) < int(1_000_000 * sample / n)).limit(int(1.25 * sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), s.as_py()) for t, s in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())], names=["y", "i", "v"]
            )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _stated(docs, chars_col).alias("stated"))
    # The sample has a bound in rows (16 bytes each), so it may go to every task and the texts stay where they are.
    made = slim.join(F.broadcast(learn), "id").select("text", "stated", "y").mapInArrow(run, "y double, i binary, v binary")
    rows = made.toArrow()
    rows = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4"), y) for y, i, v in zip(rows["y"].to_pylist(), rows["i"].to_pylist(), rows["v"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[0].tobytes(), r[2]))  # an order of its own, whatever the tasks' order
    return fit(rows)


def quality_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", chars_col: str = "n_chars") -> DataFrame:
    """One row per document: id, fold, score of label 1 and prediction."""
    model = model or train(docs, labels, text_col, id_col, label_col, chars_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py(), s.as_py()) for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _stated(docs, chars_col).alias("stated"))
    scored = slim.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
