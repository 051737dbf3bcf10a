"""Styles: the physical choices of a plan, and which go together.

All styles of an algorithm give one result; each axis changes what is joined, or
how it is laid out, partitioned or reduced.  Execution is bulk-synchronous, so there is
no axis of determinism: every style is deterministic.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALGORITHMS = ("bfs", "sssp", "cc", "mis", "pr", "tc")


@dataclass(frozen=True)
class Style:
    """granularity: arcs as rows, or lists of arcs by vertex; drive: all vertices or those that changed;
    flow: arcs laid out by the end that sends (push) or that receives (pull); update: compare with the state before
    or after messages are combined; worklist: distinct messages or one per vertex; schedule: ranges, residues or hashes
    of vertices, four times the partitions, arcs kept in memory or read again each step; unit: most arcs of
    one list; reduction of sums: one aggregate, a sum per partition first, or a metric of the write."""

    granularity: str = "edge"
    drive: str = "data"
    flow: str = "push"
    update: str = "rmw"
    worklist: str = "nondup"
    schedule: str = "default"
    unit: str = "thread"
    reduction: str = "reduction"

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) not in CHOICES[f.name]:
                raise ValueError(f"{f.name}={getattr(self, f.name)!r} is not one of {CHOICES[f.name]}")

    @property
    def name(self) -> str:
        return "-".join(getattr(self, f.name) for f in fields(self))


CHOICES = {
    "granularity": ("vertex", "edge"),
    "drive": ("topo", "data"),
    "flow": ("push", "pull"),
    "update": ("rw", "rmw"),
    "worklist": ("dup", "nondup"),
    "schedule": ("block", "cyclic", "default", "dynamic", "nonpersist"),
    "unit": ("thread", "warp", "block"),
    "reduction": ("reduction", "block", "global"),
}
#: Axes that an algorithm has; the others keep their defaults.
AXES = {
    "bfs": ("granularity", "drive", "flow", "update", "worklist", "schedule", "unit"),
    "sssp": ("granularity", "drive", "flow", "update", "worklist", "schedule", "unit"),
    "cc": ("granularity", "drive", "flow", "update", "worklist", "schedule", "unit"),
    "mis": ("granularity", "drive", "flow"),
    "pr": ("flow", "schedule", "reduction"),
    "tc": ("granularity", "reduction"),
}
#: Arcs of one list, about; a hub's arcs are many lists.
LISTS = {"thread": 1 << 16, "block": 512, "warp": 32}


def legal(algorithm: str, style: Style) -> bool:
    """Whether the style makes sense for the algorithm."""
    plain = Style()
    if any(getattr(style, f.name) != getattr(plain, f.name) for f in fields(style) if f.name not in AXES[algorithm]):
        return False
    if style.unit != "thread" and style.granularity != "vertex":
        return False
    # A worklist needs a frontier.
    return not (style.drive == "topo" and style.worklist == "dup")


def styles(algorithm: str, **fixed: str) -> Iterator[Style]:
    """All legal styles, with some axes fixed."""
    axes = [a for a in CHOICES if a in AXES[algorithm] and a not in fixed]
    for values in itertools.product(*(CHOICES[a] for a in axes)):
        style = Style(**dict(zip(axes, values, strict=True)), **fixed)
        if legal(algorithm, style):
            yield style


def laid_out(arcs: DataFrame, key: str, style: Style, slots: int) -> DataFrame:
    """Arcs partitioned by an end as the schedule says, so that supersteps need not move them."""
    if style.schedule == "block":
        return arcs.repartitionByRange(slots, key)
    if style.schedule == "cyclic":
        return arcs.repartition(slots, F.pmod(key, F.lit(slots)))
    return arcs.repartition(4 * slots if style.schedule == "dynamic" else slots, key)
