"""The registered graph and result-analytics queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.arith import priority
from sparkloom.graph import Graph, copurchase, line_order, part_supplier
from sparkloom.operators import independent_set as mis
from sparkloom.operators import rank, relax, results, triangles, verify
from sparkloom.plans.styles import AXES, Style, styles
from sparkloom.session import discard, fresh_path, materialize
from sparkloom.sources.egr import read_egr, write_egr
from sparkloom.sources.results import parse_log, read_logs, read_results, write_logs, write_results
from sparkloom.sources.sample import COLUMNS, SAMPLE_LOG, sample_results, sample_rows

Query = Callable[[SparkSession, str], DataFrame]

#: Styles that are registered as queries of their own, one for each choice of plan.
STYLED = {
    "bfs": (Style(), Style("edge", "topo"), Style("vertex", "topo", "pull"), Style("vertex", unit="warp"), Style("vertex", update="rw", worklist="dup"), Style(schedule="block")),
    "sssp": (Style(), Style("edge", "topo"), Style("vertex", flow="pull", unit="block"), Style(update="rw", worklist="dup", schedule="dynamic"), Style(schedule="nonpersist")),
    "cc": (Style(), Style("edge", "topo"), Style("vertex", "topo", "pull", schedule="block"), Style(schedule="cyclic")),
    "mis": (Style(), Style("edge", "topo"), Style("vertex", "topo", "pull"), Style("vertex", "data", "pull")),
    "pr": (Style(), Style(flow="pull"), Style(schedule="dynamic", reduction="block"), Style(reduction="global")),
    "tc": (Style("edge"), Style("vertex", reduction="block"), Style("edge", reduction="global")),
}


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    return copurchase(spark, sf_dir).prepared()


def _tagged(spark: SparkSession) -> DataFrame:
    return results.parse_tags(sample_results(spark))


def _ranks(g: Graph, style: Style | None = None) -> DataFrame:
    return rank.pagerank(g, style=style).select("id", F.round("score", 12).alias("score"))


def _styled(algorithm: str, style: Style) -> Query:
    run = {
        "bfs": lambda g: relax.bfs(g, 0, style),
        "sssp": lambda g: relax.sssp(g, 0, style),
        "cc": lambda g: relax.components(g, style),
        "mis": lambda g: mis.independent_set(g, style),
        "pr": lambda g: _ranks(g, style),
        "tc": lambda g: triangles.triangles(g, style),
    }[algorithm]
    return lambda spark, sf_dir: run(_graph(spark, sf_dir))


def _log(spark: SparkSession) -> DataFrame:
    lines = spark.createDataFrame([("log", i, line) for i, line in enumerate(SAMPLE_LOG)], "source string, pos long, line string")
    return parse_log(lines, "32_2d_")


def _egr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted graph, written to a binary file and scanned from it."""
    g = _graph(spark, sf_dir).weighted()
    path = fresh_path(spark, "graph") + ".egr"
    discard(materialize(spark.range(1), "folder"))  # makes the folder
    write_egr(g, path)
    return read_egr(spark, path, directed=False).edges


def _log_files(spark: SparkSession) -> DataFrame:
    path = fresh_path(spark, "logs")
    write_logs(spark.createDataFrame(list(enumerate(SAMPLE_LOG)), "pos long, line string"), path)
    return read_logs(spark, path, "32_2d_")


def _csv(spark: SparkSession) -> DataFrame:
    path = fresh_path(spark, "csv")
    write_results(sample_results(spark), path, "bfs")
    return read_results(spark, path, "bfs")


def _figure(spark: SparkSession, name: str) -> DataFrame:
    rows = results.ratios(_tagged(spark), *results.FIGURES[name]).where("ratio > 0")
    out = results.quantile_summary(rows)
    return out.select("algorithm", "n", "least", "most", "quarter_low", "median", "quarter_high", "eighth_low", "eighth_high", F.round("mean", 6).alias("mean"), F.round("geomean", 6).alias("geomean"))


def _run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run prints: algorithm, source, rounds and answer, by the distributed plans."""
    g, style = _graph(spark, sf_dir), Style()
    hops = relax.relax(g, spark.range(1).select("id", F.lit(0).cast("long").alias("value")), lambda v, _: v + 1, "bfs", style)
    ranks, rounds = rank.pagerank_rounds(g, style=style)
    answer = relax.farthest(hops.state.select("id", F.col("value").alias("dist"))).first()
    top = ranks.orderBy(F.desc("score"), "id").first()
    return spark.createDataFrame([("bfs", 0, hops.rounds - 1, answer["id"], float(answer["dist"])), ("pr", None, rounds, top["id"], round(top["score"], 12))], "algorithm string, source long, rounds long, vertex long, value double")


def _sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("vertices"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "graph_arcs": lambda s, d: copurchase(s, d).edges,
        "graph_weights": lambda s, d: copurchase(s, d).weighted().edges,
        "graph_adjacency": lambda s, d: copurchase(s, d).adjacency().select("id", F.array_join("nbrs", ",").alias("nbrs")),
        "graph_degrees": lambda s, d: copurchase(s, d).degrees(),
        "graph_summary": lambda s, d: copurchase(s, d).degree_summary(),
        "graph_violations": lambda s, d: _graph(s, d).violations(),
        "graph_bipartite_summary": lambda s, d: part_supplier(s, d).degree_summary(),
        "bfs_levels": lambda s, d: relax.bfs(_graph(s, d)),
        "bfs_farthest": lambda s, d: relax.farthest(relax.bfs(_graph(s, d))),
        "bfs_farthest_sentinel": lambda s, d: relax.farthest(relax.bfs(_graph(s, d)), sentinel=True),
        "sssp_distances": lambda s, d: relax.sssp(_graph(s, d)),
        "sssp_farthest": lambda s, d: relax.farthest(relax.sssp(_graph(s, d))),
        "cc_labels": lambda s, d: relax.components(_graph(s, d)),
        "cc_sizes": lambda s, d: _sizes(relax.components(_graph(s, d))),
        "cc_count": lambda s, d: relax.components(_graph(s, d)).agg(F.count_distinct("label").alias("components")),
        "mis_priorities": lambda s, d: copurchase(s, d).vertices.select("id", priority(F.col("id")).alias("priority"), priority(F.col("id"), True).alias("signed_priority")),
        "mis_set": lambda s, d: mis.independent_set(_graph(s, d)),
        "mis_set_signed": lambda s, d: mis.independent_set(_graph(s, d), signed=True),
        "mis_size": lambda s, d: mis.set_size(mis.independent_set(_graph(s, d))),
        "pr_scores": lambda s, d: _ranks(_graph(s, d)),
        "pr_top": lambda s, d: _ranks(_graph(s, d)).orderBy(F.desc("score"), "id").limit(10),
        "tc_total": lambda s, d: triangles.triangles(_graph(s, d)),
        "graph_file": _egr,
        "run_report": _run_report,
        "directed_violations": lambda s, d: line_order(s, d).prepared().violations(),
        "directed_bfs": lambda s, d: relax.bfs(line_order(s, d).prepared(), 1),
        "directed_bfs_push": lambda s, d: relax.bfs(line_order(s, d).prepared(), 1, Style()),
        "directed_bfs_pull": lambda s, d: relax.bfs(line_order(s, d).prepared(), 1, Style(flow="pull")),
        "directed_components": lambda s, d: relax.components(line_order(s, d).prepared()),
        "directed_components_pull": lambda s, d: relax.components(line_order(s, d).prepared(), Style("vertex", flow="pull")),
        "directed_triangles": lambda s, d: triangles.triangles(line_order(s, d).prepared()),
        "tc_per_vertex": lambda s, d: triangles.triangles_per_vertex(_graph(s, d)),
        "verify_bfs": lambda s, d: (lambda g: verify.verify_distances(g, relax.bfs(g), 0))(_graph(s, d)),
        "verify_sssp": lambda s, d: (lambda g: verify.verify_distances(g, relax.sssp(g), 0, weighted=True))(_graph(s, d)),
        "verify_cc": lambda s, d: (lambda g: verify.verify_components(g, relax.components(g)))(_graph(s, d)),
        "verify_mis": lambda s, d: (lambda g: verify.verify_independent_set(g, mis.independent_set(g)))(_graph(s, d)),
        "verify_pr": lambda s, d: (lambda g: rank.residual(g, rank.pagerank(g)).select((F.col("residual") < rank.TOLERANCE).alias("settled")))(_graph(s, d)),
        "style_counts": lambda s, d: s.createDataFrame([(a, sum(1 for _ in styles(a))) for a in AXES], "algorithm string, styles long"),
        "results_log": lambda s, d: _log(s),
        "results_tags": lambda s, d: _tagged(s).select(F.trim(F.regexp_replace("filename", "\n", "")).alias("filename"), "throughput", *COLUMNS[2:]),
        "results_push_pull": lambda s, d: results.ratios(_tagged(s), *results.FIGURES["push_pull"]).select("algorithm", "model", "graph", "granularity", "drive", "determinism", "schedule", "over", "under", "ratio"),
        "results_quantiles": lambda s, d: results.quantile_summary(results.ratios(_tagged(s), *results.FIGURES["det_nondet"]).select("algorithm", "ratio").where("ratio > 0")).select("algorithm", "n", "least", "most", "quarter_low", "median", "quarter_high", F.round("mean", 6).alias("mean"), F.round("geomean", 6).alias("geomean")),
        "results_matrix": lambda s, d: results.style_matrix(_tagged(s)).where("mean_ratio IS NOT NULL"),
        "results_styles": lambda s, d: results.style_summary(_tagged(s)).select("style", "n", "median", "median_difference", *[F.round(c, 6).alias(c) for c in ("mean", "spread", "mean_difference")]),
        "results_correlation": lambda s, d: results.property_correlation(_tagged(s)),
        "results_log_files": lambda s, d: _log_files(s),
        "results_csv": lambda s, d: _csv(s),
        "results_named": lambda s, d: results.named(_tagged(s), "CudaAtomic", keep=False).groupBy("model").agg(F.count("*").alias("runs")),
        "results_letters": lambda s, d: results.letter_values(results.ratios(_tagged(s), *results.FIGURES["vertex_edge"])),
        "results_style_correlation": lambda s, d: results.style_correlation(results.named(_tagged(s), "CudaAtomic", keep=False)),
        "results_style_properties": lambda s, d: results.style_property_correlation(_tagged(s)),
        "results_merged": lambda s, d: results.merged(_tagged(s).withColumn("filename", F.regexp_replace("filename", "\n", "")), "V", ("Push", "Determ")),
        "results_pivot": lambda s, d: results.pivoted(results.style_matrix(_tagged(s)), "median_ratio").select("base", "V", "E", "Topo", "Data", "Push", "Pull"),
        "results_side_by_side": lambda s, d: results.side_by_side({"push": _tagged(s).where("flow = 'Push'"), "warp": _tagged(s).where("unit = 'Warp'")}, value="throughput"),
    }
    for name in results.FIGURES:
        out[f"results_figure_{name}"] = lambda s, d, name=name: _figure(s, name)
    for algorithm, chosen in STYLED.items():
        for style in chosen:
            own = "_".join(v for v in (style.granularity, style.drive, style.flow, style.update, style.worklist, style.schedule, style.unit, style.reduction))
            out[f"{algorithm}_style_{own}"] = _styled(algorithm, style)
    return out


# SQL ------------------------------------------------------------------------------------------------------------

_EDGES = """lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 40),
e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lines a JOIN lines b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey),
v AS MATERIALIZED (SELECT unnest(range(0, (SELECT count(*) FROM part))) AS id)"""
_WRAP = "((({x}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
_WEIGHT = f"abs(1 + ({_WRAP.format(x='src * dst')}) % (SELECT count(*) FROM part))"
_HASHED = "h0 AS (SELECT id, (id + 712313887) & 4294967295 AS x FROM v), h1 AS (SELECT id, ((xor(x >> 16, x)) * 73244475) & 4294967295 AS x FROM h0), h2 AS (SELECT id, ((xor(x >> 16, x)) * 73244475) & 4294967295 AS x FROM h1), h AS MATERIALIZED (SELECT id, xor(x >> 16, x) AS u, CASE WHEN xor(x >> 16, x) >= 2147483648 THEN xor(x >> 16, x) - 4294967296 ELSE xor(x >> 16, x) END AS s FROM h2)"
_BFS = f"WITH RECURSIVE {_EDGES}, r(id, d) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT dst, d + 1 FROM r JOIN e ON src = id WHERE d < 64), b AS (SELECT v.id, min(d) AS dist FROM v LEFT JOIN r ON v.id = r.id GROUP BY v.id)"
_SSSP = f"""WITH RECURSIVE {_EDGES}, w AS MATERIALIZED (SELECT src, dst, {_WEIGHT} AS w FROM e),
r(id, d) USING KEY (id) AS (
  SELECT 0::BIGINT, 0::BIGINT
  UNION SELECT n.id, n.d FROM (SELECT dst AS id, min(d + w)::BIGINT AS d FROM r JOIN w ON src = id GROUP BY dst) n LEFT JOIN recurring.r o ON o.id = n.id WHERE o.d IS NULL OR n.d < o.d),
b AS (SELECT v.id, d AS dist FROM v LEFT JOIN r ON v.id = r.id)"""
_CC = f"""WITH RECURSIVE {_EDGES},
r(id, label) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION SELECT n.id, n.label FROM (SELECT dst AS id, min(label) AS label FROM r JOIN e ON src = id GROUP BY dst) n JOIN recurring.r o ON o.id = n.id WHERE n.label < o.label)"""


def _mis_sql(value: str, rounds: int = 24) -> str:
    parts = [f"WITH {_EDGES}, {_HASHED}, k AS MATERIALIZED (SELECT src AS weak, dst AS strong FROM e JOIN h a ON a.id = src JOIN h b ON b.id = dst WHERE (a.{value}, a.id) < (b.{value}, b.id)), s0 AS (SELECT id, 0 AS st FROM v)"]
    for i in range(rounds):
        parts.append(
            f"s{i + 1} AS MATERIALIZED (SELECT s.id, CASE WHEN s.st <> 0 THEN s.st WHEN NOT coalesce(bool_or(t.st <> 2), false) THEN 1 WHEN bool_or(t.st = 1) THEN 2 ELSE 0 END AS st "
            f"FROM s{i} s LEFT JOIN k ON k.weak = s.id LEFT JOIN s{i} t ON t.id = k.strong GROUP BY s.id, s.st)"
        )
    return ", ".join(parts) + f", m AS (SELECT h.id, h.{value}::BIGINT AS priority, st::TINYINT AS status FROM s{rounds} JOIN h USING (id))"


def _pr_sql(rounds: int = 40) -> str:
    parts = [f"WITH {_EDGES}, n AS (SELECT count(*) AS n FROM v), g AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM e), p0 AS (SELECT id, 1.0::DOUBLE / (SELECT n FROM n) AS score, 1.0::DOUBLE AS change FROM v)"]
    for i in range(rounds):
        parts.append(
            f"p{i + 1} AS MATERIALIZED (SELECT p.id, (1 - 0.85::DOUBLE) / (SELECT n FROM n) + 0.85::DOUBLE * coalesce(x.incoming, 0) AS score, abs((1 - 0.85::DOUBLE) / (SELECT n FROM n) + 0.85::DOUBLE * coalesce(x.incoming, 0) - p.score) AS change "
            f"FROM p{i} p LEFT JOIN (SELECT dst AS id, sum(score / degree) AS incoming FROM g JOIN p{i} ON id = src GROUP BY dst) x USING (id))"
        )
    every = " UNION ALL ".join(f"SELECT {i} AS k, * FROM p{i}" for i in range(1, rounds + 1))
    return ", ".join(parts) + f", q AS MATERIALIZED ({every}), z AS (SELECT k FROM q GROUP BY k HAVING sum(change) < 1e-4 ORDER BY k LIMIT 1), ranks AS (SELECT id, round(score, 12) AS score FROM q WHERE k = (SELECT k FROM z))"


def _checks(*names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 0::BIGINT)" for n in names) + ") t(\"check\", violations)"


def _values() -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ["(" + ", ".join([str(k), f"'{r[0].strip()}'", f"{r[1]}::DOUBLE", *map(cell, r[2:])]) + ")" for k, r in enumerate(sample_rows())]
    return f"WITH t(pos, {', '.join(COLUMNS)}) AS (VALUES {', '.join(rows)})"


_TAGS = (
    ("V", "granularity"), ("E", "granularity"), ("Topo", "drive"), ("Data", "drive"), ("Dup", "worklist"), ("NonDup", "worklist"), ("Push", "flow"), ("Pull", "flow"),
    ("ReadWrite", "update"), ("ReadModifyWrite", "update"), ("Determ", "determinism"), ("NonDeterm", "determinism"), ("Persist", "persistence"), ("NonPersist", "persistence"),
    ("Thread", "unit"), ("Warp", "unit"), ("Block", "unit"), ("GlobalAdd", "reduction"), ("BlockAdd", "reduction"), ("Reduction", "reduction"),
)
_PER_TAG = " UNION ALL ".join(f"SELECT '{tag}' AS style, throughput AS v, filename, pos, graph, atomics FROM t WHERE {axis} = '{tag}'" for tag, axis in _TAGS)


def _styles_sql() -> str:
    return f"""{_values()}, s AS ({_PER_TAG}),
a AS (SELECT style, count(*) AS n, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS spread FROM s GROUP BY style)
SELECT style, n, round(mean, 6) AS mean, median, round(spread, 6) AS spread, round(mean / (SELECT mean FROM a WHERE style = 'V') - 1, 6) AS mean_difference,
       median / (SELECT median FROM a WHERE style = 'V') - 1 AS median_difference FROM a"""


def _matrix_sql() -> str:
    return f"""{_values()}, s AS ({_PER_TAG}), o AS (SELECT DISTINCT style AS other FROM s),
x AS (SELECT b.style AS base, o.other, b.v, z.style IS NOT NULL AS has FROM s b JOIN o ON true LEFT JOIN s z ON z.style = o.other AND z.filename = b.filename)
SELECT base, other, round(avg(v) FILTER (has) / avg(v) FILTER (NOT has), 4) AS mean_ratio, round(median(v) FILTER (has) / median(v) FILTER (NOT has), 4) AS median_ratio
FROM x GROUP BY base, other HAVING mean_ratio IS NOT NULL"""


def _style_correlation_sql() -> str:
    return f"""{_values()}, s AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY pos) AS place FROM ({_PER_TAG}) WHERE atomics IS DISTINCT FROM 'CudaAtomic'), o AS (SELECT DISTINCT style AS other FROM s),
x AS (SELECT b.style AS base, o.other, b.place, b.pos, b.v, z.style IS NOT NULL AS has FROM s b JOIN o ON true LEFT JOIN s z ON z.style = o.other AND z.filename = b.filename),
h AS (SELECT base, other, v, row_number() OVER (PARTITION BY base, other ORDER BY pos) AS place FROM x WHERE has)
SELECT l.base, l.other, round(corr(l.v, h.v), 4) AS correlation FROM x l JOIN h ON NOT l.has AND h.base = l.base AND h.other = l.other AND h.place = l.place GROUP BY ALL"""


def _pairs_sql(axis: str, over: str, under: str) -> str:
    keys = [c for c in COLUMNS[2:] if c != axis]
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in keys)
    return f"{_values()}, r AS (SELECT {', '.join('a.' + c for c in keys)}, a.throughput AS over, b.throughput AS under, a.throughput / CASE WHEN b.throughput = 0 THEN 4e-7 ELSE b.throughput END AS ratio FROM t a JOIN t b ON a.{axis} = '{over}' AND b.{axis} = '{under}' AND {same})"


def _figure_sql(name: str) -> str:
    return f"""{_pairs_sql(*results.FIGURES[name])} SELECT algorithm, count(*) AS n, min(ratio) AS least, max(ratio) AS most, quantile_cont(ratio, 0.25) AS quarter_low, median(ratio) AS median,
quantile_cont(ratio, 0.75) AS quarter_high, quantile_cont(ratio, 0.125) AS eighth_low, quantile_cont(ratio, 0.875) AS eighth_high, round(avg(ratio), 6) AS mean, round(exp(avg(ln(ratio))), 6) AS geomean FROM r WHERE ratio > 0 GROUP BY algorithm"""


def _properties_sql() -> str:
    names = [c.split()[0] for c in results.PROPERTY_COLUMNS.split(", ")]
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in results.GRAPH_PROPERTIES)
    columns = ", ".join(f"round(corr(v, {c}::DOUBLE), 4) AS {c}" for c in names[1:])
    return f"{_values()}, g({', '.join(names)}) AS (VALUES {rows}), s AS ({_PER_TAG}) SELECT style, {columns} FROM s JOIN g USING (graph) GROUP BY style"


def _correlation_sql() -> str:
    names = [c.split()[0] for c in results.PROPERTY_COLUMNS.split(", ")]
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in results.GRAPH_PROPERTIES)
    columns = ", ".join(f"round(corr(throughput, {c}::DOUBLE), 4) AS {c}" for c in names[1:])
    return f"{_values()}, g({', '.join(names)}) AS (VALUES {rows}) SELECT algorithm, {columns} FROM t JOIN g USING (graph) GROUP BY algorithm"


def _summary_sql(arcs: str) -> str:
    return f"""{arcs}, d AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)
SELECT count(*) AS vertices, sum(degree)::BIGINT AS arcs, avg(degree) AS avg_degree, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS isolated,
       count(*) FILTER (degree >= 32) / count(*) AS share_32, count(*) FILTER (degree >= 512) / count(*) AS share_512 FROM d"""


_LETTERS = " UNION ALL ".join(f"SELECT algorithm, {k} AS letter, quantile_cont(ratio, {0.5**k}) AS low, quantile_cont(ratio, {1 - 0.5**k}) AS high FROM r GROUP BY algorithm" for k in range(1, 6))
_DIRECTED = """e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_quantity >= 40 AND b.l_quantity >= 40 AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey),
v AS MATERIALIZED (SELECT unnest(range(0, (SELECT count(*) FROM part))) AS id)"""
_BOTH = "e AS MATERIALIZED (SELECT src, dst FROM d UNION SELECT dst, src FROM d)"


def _report_sql(pr: str) -> str:
    return f"""SELECT 'bfs' AS algorithm, 0::BIGINT AS source, (SELECT max(dist) FROM ({_BFS} SELECT dist FROM b)) AS rounds, id AS vertex, dist::DOUBLE AS value
FROM ({_BFS} SELECT id, dist FROM b WHERE dist IS NOT NULL ORDER BY dist DESC, id LIMIT 1)
UNION ALL SELECT 'pr', NULL, (SELECT k FROM ({pr} SELECT k FROM z)), id, score FROM ({pr} SELECT id, score FROM ranks ORDER BY score DESC, id LIMIT 1)"""


def oracle_sql() -> dict[str, str]:
    g = f"WITH {_EDGES}"
    directed = _BFS.replace(_EDGES, _DIRECTED).replace("SELECT 0::BIGINT, 0::BIGINT UNION", "SELECT 1::BIGINT, 0::BIGINT UNION") + " SELECT id, dist FROM b"
    weak = _DIRECTED.replace("e AS MATERIALIZED", "d AS MATERIALIZED", 1) + ", " + _BOTH
    tri = f"{g}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst AND x.src < x.dst AND y.src < y.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)"
    two_sided = "WITH p AS (SELECT count(*) AS n FROM part), o AS (SELECT DISTINCT l_partkey AS src, l_suppkey + (SELECT n FROM p) AS dst FROM lineitem), e AS (SELECT * FROM o UNION SELECT dst, src FROM o), v AS (SELECT unnest(range(0, (SELECT n FROM p) + (SELECT count(*) FROM supplier))) AS id)"
    unsigned, signed, pr = _mis_sql("u"), _mis_sql("s"), _pr_sql()
    bfs, sssp, cc = f"{_BFS} SELECT id, dist FROM b", f"{_SSSP} SELECT id, dist FROM b", f"{_CC} SELECT id, label FROM r"
    out = {
        "graph_arcs": f"{g} SELECT src, dst FROM e",
        "graph_weights": f"{g} SELECT src, dst, {_WEIGHT} AS weight FROM e",
        "graph_adjacency": f"{g} SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS nbrs FROM e GROUP BY src",
        "graph_degrees": f"{g} SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id",
        "graph_summary": _summary_sql(g),
        "graph_violations": _checks("out_of_range", "self_loop", "duplicate", "one_way"),
        "graph_bipartite_summary": _summary_sql(two_sided),
        "bfs_levels": bfs,
        "bfs_farthest": f"{_BFS} SELECT id, dist FROM b WHERE dist IS NOT NULL ORDER BY dist DESC, id LIMIT 1",
        "bfs_farthest_sentinel": f"{_BFS} SELECT id, coalesce(dist, 2147483647) AS dist FROM b ORDER BY 2 DESC, 1 LIMIT 1",
        "sssp_distances": sssp,
        "sssp_farthest": f"{_SSSP} SELECT id, dist FROM b WHERE dist IS NOT NULL ORDER BY dist DESC, id LIMIT 1",
        "cc_labels": cc,
        "cc_sizes": f"{_CC} SELECT label, count(*) AS vertices FROM r GROUP BY label",
        "cc_count": f"{_CC} SELECT count(DISTINCT label) AS components FROM r",
        "mis_priorities": f"{g}, {_HASHED} SELECT id, u::BIGINT AS priority, s::BIGINT AS signed_priority FROM h",
        "mis_set": f"{unsigned} SELECT * FROM m",
        "mis_set_signed": f"{signed} SELECT * FROM m",
        "mis_size": f"{unsigned} SELECT count(*) FILTER (status = 1) AS included, round(100.0::DOUBLE * count(*) FILTER (status = 1) / count(*), 1) AS percent FROM m",
        "pr_scores": f"{pr} SELECT id, score FROM ranks",
        "pr_top": f"{pr} SELECT id, score FROM ranks ORDER BY score DESC, id LIMIT 10",
        "tc_total": f"{tri} SELECT count(*) AS triangles FROM t",
        "tc_per_vertex": f"{tri}, c AS (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) SELECT v.id, count(c.id) AS triangles FROM v LEFT JOIN c ON c.id = v.id GROUP BY v.id",
        "verify_bfs": _checks("source", "relaxable", "unsupported", "missing"),
        "verify_sssp": _checks("source", "relaxable", "unsupported", "missing"),
        "verify_cc": _checks("split", "not_least", "no_root", "missing"),
        "verify_mis": _checks("undecided", "dependent", "not_maximal", "missing"),
        "verify_pr": "SELECT true AS settled",
        "results_log": "SELECT * FROM (VALUES ('32_2d_alpha_CPP.cpp', 1.5::DOUBLE), ('32_2d_beta_CPP.cpp', NULL), ('32_2d_gamma_CPP.cpp', 2.25)) t(program, throughput)",
        "results_tags": f"{_values()} SELECT * EXCLUDE (pos) FROM t",
        "results_push_pull": f"{_pairs_sql('flow', 'Push', 'Pull')} SELECT algorithm, model, graph, granularity, drive, determinism, schedule, over, under, ratio FROM r",
        "results_quantiles": f"{_pairs_sql('determinism', 'Determ', 'NonDeterm')} SELECT algorithm, count(*) AS n, min(ratio) AS least, max(ratio) AS most, quantile_cont(ratio, 0.25) AS quarter_low, median(ratio) AS median, quantile_cont(ratio, 0.75) AS quarter_high, round(avg(ratio), 6) AS mean, round(exp(avg(ln(ratio))), 6) AS geomean FROM r WHERE ratio > 0 GROUP BY algorithm",
        "results_matrix": _matrix_sql(),
        "results_styles": _styles_sql(),
        "results_correlation": _correlation_sql(),
        "graph_file": f"{g} SELECT src, dst, {_WEIGHT} AS weight FROM e",
        "run_report": _report_sql(pr),
        "directed_violations": f"WITH {_DIRECTED} SELECT * FROM (VALUES ('out_of_range', 0::BIGINT), ('self_loop', 0), ('duplicate', 0)) t(\"check\", violations) UNION ALL SELECT 'one_way', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)",
        "directed_bfs": directed,
        "directed_bfs_push": directed,
        "directed_bfs_pull": directed,
        "directed_components": f"{_CC.replace(_EDGES, weak)} SELECT id, label FROM r",
        "directed_components_pull": f"{_CC.replace(_EDGES, weak)} SELECT id, label FROM r",
        "directed_triangles": f"{tri.replace(_EDGES, weak)} SELECT count(*) AS triangles FROM t",
        "results_log_files": "SELECT * FROM (VALUES ('32_2d_alpha_CPP.cpp', 1.5::DOUBLE), ('32_2d_beta_CPP.cpp', NULL), ('32_2d_gamma_CPP.cpp', 2.25)) t(program, throughput)",
        "results_csv": f"{_values()} SELECT filename, throughput FROM t",
        "results_named": f"{_values()} SELECT model, count(*) AS runs FROM t WHERE filename NOT LIKE '%CudaAtomic%' GROUP BY model",
        "results_letters": f"{_pairs_sql(*results.FIGURES['vertex_edge'])} {_LETTERS}",
        "results_style_correlation": _style_correlation_sql(),
        "results_style_properties": _properties_sql(),
        "results_merged": f"{_values()} SELECT filename, throughput, throughput AS \"Push\", throughput AS \"Determ\" FROM t WHERE granularity = 'V' AND flow = 'Push' AND determinism = 'Determ'",
        "results_pivot": f"SELECT base, " + ", ".join(f"max(median_ratio) FILTER (other = '{x}') AS \"{x}\"" for x in ("V", "E", "Topo", "Data", "Push", "Pull")) + f" FROM ({_matrix_sql().replace('HAVING mean_ratio IS NOT NULL', '')}) GROUP BY base",
        "results_side_by_side": f"{_values()}, p AS (SELECT row_number() OVER (ORDER BY pos) AS place, throughput AS push FROM t WHERE flow = 'Push'), w AS (SELECT row_number() OVER (ORDER BY pos) AS place, throughput AS warp FROM t WHERE unit = 'Warp') SELECT place, push, warp FROM p FULL JOIN w USING (place)",
    }
    out |= {f"results_figure_{name}": _figure_sql(name) for name in results.FIGURES}
    same = {"bfs": bfs, "sssp": sssp, "cc": cc, "mis": out["mis_set"], "pr": out["pr_scores"], "tc": out["tc_total"]}
    for name in queries():
        if "_style_" in name and name not in out:
            out[name] = same[name.split("_")[0]]
    return out
