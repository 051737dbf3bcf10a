"""Result analytics: style tags of program names, ratios, matrices and quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Style tags by axis, as they stand in names (fixed values).
AXES = {
    "algorithm": ("BFS", "SSSP", "CC", "MIS", "PR", "TC"),
    "model": ("CPP", "OMP", "CUDA"),
    "granularity": ("V", "E"),
    "drive": ("Topo", "Data"),
    "worklist": ("Dup", "NonDup"),
    "flow": ("Push", "Pull"),
    "update": ("ReadWrite", "ReadModifyWrite"),
    "determinism": ("Determ", "NonDeterm"),
    "persistence": ("Persist", "NonPersist"),
    "unit": ("Thread", "Warp", "Block"),
    "reduction": ("GlobalAdd", "BlockAdd", "Reduction", "Critical", "ClauseRed", "AtomicAdd"),
    "schedule": ("Block", "Cyclic", "Default", "Dynamic"),
    "atomics": ("Atomic", "CudaAtomic"),
}
GRAPHS = ("rmat", "ny", "2d", "soc", "co")
#: Other spellings of tags.
ALIASES = {"PUSH": "Push", "PULL": "Pull", "DETERMIN": "Determ", "NONDETERMIN": "NonDeterm", "DEFAULTSCHED": "Default", "DYNAMICSCHED": "Dynamic", "COPYDETERM": "Determ", "MERGEDETERM": "Determ"}
#: Published properties of the five graphs (fixed values).
GRAPH_PROPERTIES = (
    ("rmat", 4194304, 65660814, 15.7, 3687, 0.124, 0.00045, 19),
    ("ny", 264346, 730100, 2.8, 8, 0.0, 0.0, 721),
    ("2d", 1048576, 4190208, 4.0, 4, 0.0, 0.0, 2047),
    ("soc", 4847571, 85702474, 17.7, 20333, 0.140, 0.00125, 20),
    ("co", 540486, 30491458, 56.4, 3299, 0.525, 0.00092, 24),
)
PROPERTY_COLUMNS = "graph string, vertices long, arcs long, avg_degree double, max_degree long, share_32 double, share_512 double, diameter long"
#: Figures: the axis and the two tags whose throughputs are divided.
FIGURES = {
    "atomic_cudaatomic": ("atomics", "Atomic", "CudaAtomic"),
    "vertex_edge": ("granularity", "V", "E"),
    "topo_data": ("drive", "Topo", "Data"),
    "dup_nondup": ("worklist", "Dup", "NonDup"),
    "push_pull": ("flow", "Push", "Pull"),
    "rw_rmw": ("update", "ReadWrite", "ReadModifyWrite"),
    "det_nondet": ("determinism", "Determ", "NonDeterm"),
    "persist_nonpersist": ("persistence", "Persist", "NonPersist"),
    "thread_warp": ("unit", "Thread", "Warp"),
    "thread_block": ("unit", "Thread", "Block"),
    "warp_block": ("unit", "Warp", "Block"),
    "global_blockadd": ("reduction", "GlobalAdd", "BlockAdd"),
    "blockadd_reduction": ("reduction", "BlockAdd", "Reduction"),
    "block_cyclic": ("schedule", "Block", "Cyclic"),
    "default_dynamic": ("schedule", "Default", "Dynamic"),
}
#: Stands for a throughput of 0 in a denominator (fixed value).
ZERO = 4e-7


def _known() -> dict[str, str]:
    out = {tag.upper(): tag for tags in AXES.values() for tag in tags}
    return out | ALIASES


def parse_tags(results: DataFrame, name: str = "filename") -> DataFrame:
    """The rows with a column per axis and the graph; axes that a name has no tag of are null.

    A name is split at underscores, dots, dashes; tags are whole parts, so that none is
    found inside another.  Where model and algorithm are glued to the front (a name of
    a GPU triangle program), the parts still tell the style.
    """
    clean = F.trim(F.regexp_replace(name, r"[\r\n]+", ""))
    raw = F.split(clean, r"[_.\-]+")
    known = F.create_map(*[F.lit(x) for pair in sorted(_known().items()) for x in pair])
    tags = F.transform(raw, lambda t: F.coalesce(known[F.upper(t)], t))
    out = results.withColumn("__tags", tags)
    t = F.col("__tags")

    def pick(axis: str) -> Column:
        hits = [F.when(F.array_contains(t, tag), F.lit(tag)) for tag in reversed(AXES[axis])]
        return F.coalesce(*hits)

    columns = {axis: pick(axis) for axis in AXES}
    glued = F.regexp_extract(clean, r"(BFS|SSSP|CC|MIS|PR|TC)_", 1)
    columns["algorithm"] = F.coalesce(columns["algorithm"], F.when(glued != "", glued))
    gpu = clean.endswith(".cu")
    columns["model"] = F.coalesce(columns["model"], F.when(gpu, F.lit("CUDA")))
    columns["unit"] = F.when(gpu, columns["unit"])
    columns["schedule"] = F.when(~gpu, columns["schedule"])
    columns["graph"] = F.coalesce(*[F.when(F.array_contains(t, g), F.lit(g)) for g in GRAPHS])
    return out.withColumns(columns).drop("__tags")


def ratios(tagged: DataFrame, axis: str, over: str, under: str, value: str = "throughput") -> DataFrame:
    """Pairs of runs that differ in one axis only, with over / under."""
    keys = [a for a in AXES if a != axis] + ["graph"]
    if axis == "unit":
        keys.remove("schedule")
    side = lambda tag, as_: tagged.where(F.col(axis) == tag).select(*keys, F.col(value).alias(as_))
    a, b = side(over, "over"), side(under, "under")
    match = reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    floor = F.when(b["under"] == 0, ZERO).otherwise(b["under"])
    return a.join(b, match).select(*[a[k] for k in keys], a["over"], b["under"], (a["over"] / floor).alias("ratio"))


def quantile_summary(ratio_rows: DataFrame, by: tuple[str, ...] = ("algorithm",), value: str = "ratio") -> DataFrame:
    """Box-plot numbers and eighths of a value per group."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.125, 0.25, 0.5, 0.75, 0.875)]))
    rows = ratio_rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.exp(F.avg(F.ln(value))).alias("geomean"), q.alias("q"))
    names = ("eighth_low", "quarter_low", "median", "quarter_high", "eighth_high")
    return rows.select(*by, "n", "least", "most", "mean", "geomean", *[F.col("q")[i].alias(x) for i, x in enumerate(names)])


def style_flags(tagged: DataFrame) -> dict[str, Column]:
    """A condition per style of the matrix."""
    pairs = [("V", "granularity"), ("E", "granularity"), ("Topo", "drive"), ("Data", "drive"), ("Dup", "worklist"), ("NonDup", "worklist"), ("Push", "flow"), ("Pull", "flow"), ("ReadWrite", "update"), ("ReadModifyWrite", "update"), ("Determ", "determinism"), ("NonDeterm", "determinism"), ("Persist", "persistence"), ("NonPersist", "persistence"), ("Thread", "unit"), ("Warp", "unit"), ("Block", "unit"), ("GlobalAdd", "reduction"), ("BlockAdd", "reduction"), ("Reduction", "reduction")]
    return {tag: F.coalesce(F.col(axis) == tag, F.lit(False)) for tag, axis in pairs}


def style_matrix(tagged: DataFrame, value: str = "throughput") -> DataFrame:
    """(base, other, mean_ratio, median_ratio): among runs with one style, those with another over those without it.

    One pass: each run is sent once per style it has and style it is compared on.
    """
    flags = style_flags(tagged)
    has = F.array_compact(F.array(*[F.when(c, F.lit(tag)) for tag, c in flags.items()]))
    every = F.array(*[F.struct(F.lit(tag).alias("other"), c.alias("with")) for tag, c in flags.items()])
    rows = tagged.select(F.col(value).alias("v"), F.explode(has).alias("base"), every.alias("every")).select("v", "base", F.inline("every"))
    side = lambda f, w: f(F.when(F.col("with") == w, F.col("v")))
    out = rows.groupBy("base", "other").agg(side(F.avg, True).alias("a"), side(F.avg, False).alias("b"), side(F.median, True).alias("c"), side(F.median, False).alias("d"))
    divide = lambda x, y: F.round(F.try_divide(F.col(x), F.col(y)), 4)
    return out.select("base", "other", divide("a", "b").alias("mean_ratio"), divide("c", "d").alias("median_ratio"))


def pivoted(matrix: DataFrame, value: str) -> DataFrame:
    """The matrix with a column per style."""
    tags = [t for t in style_flags(matrix)]
    return matrix.groupBy("base").pivot("other", tags).agg(F.first(value))


def style_summary(tagged: DataFrame, value: str = "throughput") -> DataFrame:
    """Mean, median and spread per style, and their difference to the vertex style."""
    flags = style_flags(tagged)
    has = F.array_compact(F.array(*[F.when(c, F.lit(tag)) for tag, c in flags.items()]))
    rows = tagged.select(F.col(value).alias("v"), F.explode(has).alias("style"))
    out = rows.groupBy("style").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("spread"))
    # One row per style: a window over all of them is at most as long as the list of styles.
    every = Window.partitionBy(F.lit(1))
    base = lambda c: F.max(F.when(F.col("style") == "V", F.col(c))).over(every)
    return out.select("style", "n", "mean", "median", "spread", (F.col("mean") / base("mean") - 1).alias("mean_difference"), (F.col("median") / base("median") - 1).alias("median_difference"))


def letter_values(rows: DataFrame, by: tuple[str, ...] = ("algorithm",), value: str = "ratio", depth: int = 5) -> DataFrame:
    """(group, letter, low, high): the median, fourths, eighths and so on of a value, ``depth`` of them."""
    ends = [0.5**k for k in range(1, depth + 1)]
    q = F.percentile(value, F.array(*[F.lit(x) for x in ends + [1 - x for x in ends]]))
    pairs = F.array(*[F.struct(F.lit(k + 1).alias("letter"), F.col("q")[k].alias("low"), F.col("q")[depth + k].alias("high")) for k in range(depth)])
    return rows.groupBy(*by).agg(q.alias("q")).select(*by, F.inline(pairs))


def named(results: DataFrame, pattern: str, keep: bool = True, name: str = "filename") -> DataFrame:
    """The runs whose name has a match of a pattern, or those whose name has none."""
    hit = F.coalesce(F.col(name).rlike(pattern), F.lit(False))
    return results.where(hit if keep else ~hit)


def _by_style(tagged: DataFrame, *columns: str) -> DataFrame:
    """A row per run and style that it has, with the styles' flags."""
    flags = style_flags(tagged)
    has = F.array_compact(F.array(*[F.when(c, F.lit(tag)) for tag, c in flags.items()]))
    every = F.array(*[F.struct(F.lit(tag).alias("other"), c.alias("with")) for tag, c in flags.items()])
    return tagged.select(*columns, every.alias("every"), F.explode(has).alias("base"))


def style_correlation(tagged: DataFrame, value: str = "throughput", order: str = "pos") -> DataFrame:
    """(base, other, correlation): runs of a style without another against those with both, by place.

    Runs are in the order of the table; the run at place i among those of the base style is paired with the i-th that
    has the other style too, if the first one has it not.
    """
    rows = _by_style(tagged, F.col(value).alias("v"), F.col(order).alias("pos"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    rows = rows.withColumn("place", place("base")).select("base", "place", "pos", "v", F.inline("every"))
    lacks = rows.where("NOT with").select("base", "other", "place", F.col("v").alias("x"))
    has = rows.where("with").withColumn("place", place("base", "other")).select("base", "other", "place", F.col("v").alias("y"))
    return lacks.join(has, ["base", "other", "place"]).groupBy("base", "other").agg(F.round(F.corr("x", "y"), 4).alias("correlation"))


def merged(tagged: DataFrame, base: str, others: tuple[str, ...], value: str = "throughput", name: str = "filename") -> DataFrame:
    """Runs of a style with a column for each other style, merged by name: those that have them all."""
    flags = style_flags(tagged)
    out = tagged.where(flags[base]).select(name, value)
    for other in others:
        out = out.join(tagged.where(flags[base] & flags[other]).select(name, F.col(value).alias(other)), name)
    return out


def side_by_side(frames: dict[str, DataFrame], value: str = "ratio", order: str = "pos") -> DataFrame:
    """Columns of several tables next to one another by place; shorter ones end in nulls."""
    out = None
    for column, df in frames.items():
        # One window: a figure's column has as many rows as runs were measured.
        one = df.select(F.row_number().over(Window.orderBy(order)).alias("place"), F.col(value).alias(column))
        out = one if out is None else out.join(one, "place", "full_outer")
    return out


def with_properties(tagged: DataFrame) -> DataFrame:
    """Runs with the published properties of their graph (five rows, broadcast)."""
    known = tagged.sparkSession.createDataFrame(list(GRAPH_PROPERTIES), PROPERTY_COLUMNS)
    return tagged.join(F.broadcast(known), "graph")


def property_correlation(tagged: DataFrame, value: str = "throughput") -> DataFrame:
    """Pearson correlation of throughput with each graph property, per algorithm."""
    names = [c.split()[0] for c in PROPERTY_COLUMNS.split(", ")][1:]
    return with_properties(tagged).groupBy("algorithm").agg(*[F.round(F.corr(value, F.col(c).cast("double")), 4).alias(c) for c in names])


def style_property_correlation(tagged: DataFrame, value: str = "throughput") -> DataFrame:
    """Pearson correlation of throughput with each graph property, per style."""
    names = [c.split()[0] for c in PROPERTY_COLUMNS.split(", ")][1:]
    rows = _by_style(with_properties(tagged), value, *names)
    return rows.groupBy(F.col("base").alias("style")).agg(*[F.round(F.corr(value, F.col(c).cast("double")), 4).alias(c) for c in names])
