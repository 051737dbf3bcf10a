"""A bit set of hashed keys as a small table, so that rows outside it need no shuffle.

The set has ``PER_KEY`` bits a key and ``MOST_BITS`` at most, 64 to a row: at most
2^20 rows (about 40 MB) are broadcast, whatever the number of keys.  A row that misses the set
has none of the keys; one that hits it may have one, and an exact join decides.  Beyond the bound
more rows hit the set by chance; results stay the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialize

LEAST_BITS, MOST_BITS = 1 << 12, 1 << 26
PER_KEY = 16


@dataclass(frozen=True)
class BitSet:
    words: DataFrame
    bits: int

    def place(self, keys: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*keys, F.lit(77)), F.lit(self.bits))

    def mark(self, df: DataFrame, *keys: str) -> DataFrame:
        """The rows with a flag ``__maybe``; a row with a null key is marked by what its other keys hash to."""
        placed = df.withColumn("__at", self.place([F.col(k) for k in keys]))
        met = placed.join(F.broadcast(self.words), F.shiftright("__at", 6) == F.col("__word"), "left")
        hit = F.coalesce(F.expr("shiftright(__bits, CAST(__at & 63 AS INT)) & 1") == 1, F.lit(False))
        return met.withColumn("__maybe", hit).drop("__at", "__word", "__bits")


def bit_set(keys: DataFrame, *columns: str) -> BitSet:
    """The set of the keys in ``columns``."""
    bits = LEAST_BITS
    wanted = min(MOST_BITS, PER_KEY * keys.count())
    while bits < wanted:
        bits *= 2
    at = BitSet(keys, bits).place([F.col(c) for c in columns])
    placed = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("__word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    return BitSet(materialize(placed.groupBy("__word").agg(F.bit_or("bit").alias("__bits")), "bits"), bits)
