"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is its runs of letters in lower case, each run between two breaks; its n-grams are the single
letters and breaks, and the pairs and triples that hold a break at an end at most.  They are counted per
language and hash bucket.  The log-probability matrix has a size that is fixed before anything is read and is
broadcast.  A whole Arrow batch is scored at once: its n-grams become one sparse matrix of
(text, bucket, count), whose product with the rows of the matrix that it touches is summed per text.

Learning uses at most ``PER_LANGUAGE`` texts of a language, chosen by a hash of
the id, never rows of the held-out fold.  Scoring reads whole texts: a text longer than ``CHUNK`` is counted
in pieces that carry the last symbols on, which gives the counts of the whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
With no labelled rows every text is ``und``; an empty table gives an empty result.  Repeated rows are scored alike; ties
go to the first language in sort order; other columns are ignored or, in
:func:`language_filter`, passed through.  More than ``languages`` languages are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._rows import carry, held_out, keep_where

#: Hash buckets, n-gram orders, texts to learn from per language, languages at most (the matrix has 32 MB then).
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
PER_LANGUAGE = 4_000
LANGUAGES = 256
#: Code points folded at once: what is held in memory, not what is counted.
CHUNK = 1 << 18
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point the lower-case code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(len(out)):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _symbols(codes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and a 0 after each run of them, and which code points those were; ``inside``: a letter came before."""
    low = _letters()[codes]
    keep = low != 0
    after = np.append(inside, keep[:-1])
    keep |= after
    return low[keep], keep


def _grams(symbols: np.ndarray, seen: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (of its second symbol, or only one) and buckets of the n-grams that end at symbol ``seen`` or later."""
    at, found = [], []
    wide = symbols.astype(np.uint64)
    for n in ORDERS:
        first = max(0, seen - n + 1)
        count = len(symbols) - n + 1 - first
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = (h + wide[first + k : first + k + count]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        place = np.arange(first, first + count) + (n > 1)
        if n > 2:  # a break stands at an end only
            whole = np.logical_and.reduce([symbols[first + k : first + k + count] != 0 for k in range(1, n - 1)])
            h, place = h[whole], place[whole]
        at.append(place)
        found.append((h >> np.uint64(17)) & np.uint64(buckets - 1))
    return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.uint64)]).astype(np.int64)


def _tally(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of keys text * buckets + bucket."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    told = keys[first].astype(np.int64)
    return told // buckets, told % buckets, np.diff(np.append(first, len(keys)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _together(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of many texts at once: each ends with a break."""
    symbols, keep = _symbols(_codes("\0".join([*texts, ""])), False)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), size)[keep]
    at, bucket = _grams(np.append(np.uint32(0), symbols), 1, buckets)
    keys = owner[at - 1] * buckets + bucket
    return _tally(keys.astype(np.uint32) if len(texts) * buckets <= 1 << 32 else keys, buckets)


def _in_pieces(text: str, buckets: int) -> np.ndarray:
    """Dense counts of one long text."""
    total = np.zeros(buckets, np.int64)
    tail = np.zeros(1, np.uint32)
    for at in range(0, len(text) + 1, CHUNK):
        part = text[at : at + CHUNK] + ("\0" if at + CHUNK > len(text) else "")
        symbols, _ = _symbols(_codes(part), bool(tail[-1]))
        line = np.append(tail, symbols)
        total += np.bincount(_grams(line, len(tail), buckets)[1], minlength=buckets)
        tail = line[1 - max(ORDERS) :]
    return total


def ngram_counts(texts: Sequence[str | None], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse counts of texts, in blocks: (number of the block's first text, text, bucket, count)."""
    start, chars, some = 0, 0, []
    for i, text in enumerate([*texts, None]):
        text = text or ""
        last = i == len(texts)
        if some and (last or chars + len(text) > CHUNK):
            yield start, *_together(some, buckets)
            some, chars = [], 0
        if last:
            return
        if len(text) > CHUNK:
            total = _in_pieces(text, buckets)
            there = total.nonzero()[0]
            yield i, np.zeros(len(there), np.int64), there, total[there]
            continue
        if not some:
            start = i
        some.append(text)
        chars += len(text) + 1


@dataclass(frozen=True)
class Model:
    """Languages in sort order, the matrix (buckets by languages) and the priors."""

    languages: tuple[str, ...]
    matrix: np.ndarray
    prior: np.ndarray

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and posteriors of a batch."""
        names, posterior = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, posterior
        for start, text, bucket, count in ngram_counts(texts, len(self.matrix)):
            if not len(text):
                continue
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            score = np.add.reduceat(count[:, None] * self.matrix[bucket], first) + self.prior
            best = score.argmax(axis=1)
            top = np.take_along_axis(score, best[:, None], 1)
            rows = start + text[first]
            posterior[rows] = 1.0 / np.exp(score - top).sum(axis=1)
            for row, b in zip(rows.tolist(), best.tolist(), strict=True):
                names[row] = self.languages[b]
        return names, posterior


def train(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, buckets: int = BUCKETS, most: int = LANGUAGES
) -> Model:
    """Fit on the rows outside the held-out fold that have a language and a text.

    ``per_language`` bounds the texts learnt from, ``most`` the languages; ``buckets`` is a power of two.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    languages = tuple(sorted(per))
    if not languages:
        return Model((), np.zeros((buckets, 0)), np.zeros(0))
    if len(languages) > most:
        raise ValueError(f"more than {most} languages")
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / per[lang]))])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1_000_000)) < share * 1_000_000)
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), buckets), np.int64)
        for batch in batches:
            own = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for start, text, bucket, n in ngram_counts(batch.column(0).to_pylist(), buckets):
                np.add.at(sums, (own[start + text], bucket), n)
        lang, bucket = sums.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(sums[lang, bucket])], names=["lang", "bucket", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang long, bucket long, n long")
    sums = np.zeros((buckets, len(languages)))
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["bucket"], r["lang"]] = r["n"]
    matrix = np.log((sums + 0.5) / (sums.sum(0) + 0.5 * buckets))
    total = sum(per.values())
    prior = np.array([math.log(per[lang] / total) for lang in languages])
    return Model(languages, matrix, prior)


def _scored(df: DataFrame, model: Model) -> DataFrame:
    """Rows of (``__row``, ``__text``) with ``lang_pred`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        names, posterior = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": posterior})

    return df.withColumn("__lang", predict(F.col("__text").cast("string")))


def language_id(df: DataFrame, model: Model | None = None, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, fold, predicted language and its posterior."""
    model = model or train(df, text_col, lang_col, id_col)
    slim = carry(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), __text=F.col("text"))
    return _scored(slim.select(F.col("__row.id").alias("id"), "__text"), model).select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("__lang.lang_pred").alias("lang_pred"), F.col("__lang.score").alias("score")
    )


def language_filter(df: DataFrame, model: Model | None = None, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a posterior of ``least`` or more."""
    model = model or train(df, text_col, lang_col, id_col)
    scored = _scored(carry(df, __text=F.col(text_col)), model)
    return keep_where(scored, (F.col("__lang.lang_pred") != UNKNOWN) & (F.col("__lang.score") >= least))
