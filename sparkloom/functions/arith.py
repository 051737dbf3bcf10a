"""Integer arithmetic as Column expressions: 32-bit wrap, hash priorities, edge weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The hash multiplier, its seed offset, and the 32-bit masks.
HASH_MULTIPLIER = 0x45D9F3B
PRIORITY_SEED = 712313887
MASK = 4294967295
HALF = 2147483648
UNREACHED = 2147483647


def wrap32(x: Column) -> Column:
    """A 64-bit value as a signed 32-bit one would hold it (no cast: ANSI mode rejects overflow)."""
    return F.pmod(x + F.lit(HALF), F.lit(MASK + 1)) - F.lit(HALF)


def mix32(x: Column) -> Column:
    """Two rounds of xor-shift and multiply on an unsigned 32-bit value, then a last xor-shift."""
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(HASH_MULTIPLIER)).bitwiseAND(F.lit(MASK))
    return F.shiftright(x, 16).bitwiseXOR(x)


def priority(vertex: Column, signed: bool = False) -> Column:
    """The selection priority of a vertex, unsigned by default."""
    p = mix32((vertex + F.lit(PRIORITY_SEED)).bitwiseAND(F.lit(MASK)))
    return wrap32(p) if signed else p


def priorities(n: int, signed: bool = False) -> np.ndarray:
    """The priorities of the vertices 0 to n-1."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(PRIORITY_SEED)) & np.uint64(MASK)
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(HASH_MULTIPLIER) & np.uint64(MASK)
    out = ((x >> np.uint64(16)) ^ x).astype(np.int64)
    return np.where(out >= HALF, out - (MASK + 1), out) if signed else out


def arc_weight(src: Column, dst: Column, vertices: int) -> Column:
    """The weight of an arc without one: a wrapped product, its truncated remainder, made positive."""
    return F.abs(F.lit(1) + wrap32(src * dst) % F.lit(vertices))
