"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the struct that carries an input row through an operator's layers.
ROW = "__row"
#: Items of a list that :func:`scan` handles at once.
RUN = 256


def carry(df: DataFrame, **columns: Column) -> DataFrame:
    """The input row as one struct next to computed columns.

    Input columns of any name thereby never clash with an operator's own.
    """
    return df.select(F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias(ROW), *[v.alias(k) for k, v in columns.items()])


def uncarry(df: DataFrame) -> DataFrame:
    """The input rows that are left, with their own columns only."""
    return df.select(f"{ROW}.*")


def fenced(df: DataFrame) -> DataFrame:
    """The same rows; filters on them stay above the projections they read.

    Pushed below, a filter would repeat their expressions over and over.  The
    partition id is not deterministic to the optimizer, so it moves nothing past it.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    return df.select(F.when(F.spark_partition_id() >= 0, row).alias("__fence")).select("__fence.*")


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Carried rows that meet ``condition``, uncarried."""
    kept = df.select(ROW, condition.alias("__keep"))
    return uncarry(fenced(kept).where("__keep"))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def scan(items: str, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """A list from one pass over the list column ``items``, with a running state.

    ``step(state, item)`` gives the next state and a list of what the item adds.  Adding to a list copies
    it, so runs of ``RUN`` items fill a list of their own and the lists are joined in the end: the time
    is in proportion to the items (times ``RUN``), not to their square.
    """
    column, none = F.col(items), F.array().cast(f"array<{kind}>")

    def add(acc: Column, item: Column) -> Column:
        after, new = step(acc, item)
        return F.struct(*[after[k].alias(k) for k in state], F.concat(acc["out"], new).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        fresh = F.struct(*[acc["now"][k].alias(k) for k in state], none.alias("out"))
        return F.struct(F.aggregate(part, fresh, add).alias("now"), F.concat(acc["lists"], F.array(acc["now"]["out"])).alias("lists"))

    first = F.struct(F.struct(*[v.alias(k) for k, v in state.items()], none.alias("out")).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("lists"))
    starts = F.sequence(F.lit(1), F.greatest(F.size(column), F.lit(1)), F.lit(RUN))
    parts = F.transform(starts, lambda i: F.slice(column, i, F.lit(RUN)))
    return F.aggregate(parts, first, run, lambda acc: F.flatten(F.concat(acc["lists"], F.array(acc["now"]["out"]))))
