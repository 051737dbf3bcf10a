import numpy as np
import pytest

from sparkloom.functions.arith import arc_weight, priority
from sparkloom.graph import Graph, from_adjacency, from_edges
from sparkloom.operators import independent_set, rank, relax, triangles, verify
from sparkloom.plans.styles import Style, styles
from tests import graphs as G


def make(spark, name):
    n, arcs = G.GRAPHS[name]
    return Graph(spark.createDataFrame(arcs, "src long, dst long"), n, directed=False)


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.mark.parametrize("name", ["tiny", "star", "empty", "single", "random"])
def test_algorithms_agree_with_plain_python(spark, name):
    n, arcs = G.GRAPHS[name]
    g = make(spark, name).prepared()
    assert pairs(relax.bfs(g)) == G.distances(n, arcs, 0, False)
    assert pairs(relax.sssp(g)) == G.distances(n, arcs, 0, True)
    assert pairs(relax.components(g)) == G.labels(n, arcs)
    assert {r["id"]: r["status"] for r in independent_set.independent_set(g).collect()} == G.greedy(n, arcs)
    assert triangles.triangles(g).first()[0] == G.triangle_count(n, arcs)
    expected, rounds = G.ranks(n, arcs)
    found, took = rank.pagerank_rounds(g)
    found = pairs(found)
    assert took == rounds
    assert all(abs(found[i] - expected[i]) < 1e-12 for i in range(n))


@pytest.mark.parametrize("signed", [False, True])
def test_independent_set_forks(spark, signed):
    n, arcs = G.GRAPHS["random"]
    found = independent_set.independent_set(make(spark, "random"), signed=signed)
    assert {r["id"]: r["status"] for r in found.collect()} == G.greedy(n, arcs, signed)


SOME = [
    ("bfs", Style()), ("bfs", Style("edge", "topo")), ("bfs", Style("vertex", "topo", "pull", unit="warp")), ("bfs", Style("vertex", update="rw", worklist="dup", schedule="block")),
    ("sssp", Style("edge", "data", update="rw", worklist="dup")), ("sssp", Style("vertex", "data", "pull", schedule="dynamic", unit="block")), ("sssp", Style(schedule="nonpersist")),
    ("cc", Style("edge", "topo", update="rw")), ("cc", Style("vertex", "data", "pull", schedule="cyclic")),
    ("mis", Style("edge", "topo")), ("mis", Style("vertex", "data", "pull")), ("mis", Style("edge", "data", "pull")), ("mis", Style("vertex", "topo")), ("mis", Style()),
    ("pr", Style(reduction="block")), ("pr", Style(flow="pull", reduction="global")),
    ("tc", Style("edge", reduction="global")), ("tc", Style("vertex", reduction="block")),
]


@pytest.mark.parametrize("algorithm,style", SOME)
def test_styles_give_one_result(spark, algorithm, style):
    n, arcs = G.GRAPHS["grid"]
    g = make(spark, "grid").prepared()
    if algorithm == "bfs":
        assert pairs(relax.bfs(g, 5, style)) == G.distances(n, arcs, 5, False)
    elif algorithm == "sssp":
        assert pairs(relax.sssp(g, 5, style)) == G.distances(n, arcs, 5, True)
    elif algorithm == "cc":
        assert pairs(relax.components(g, style)) == G.labels(n, arcs)
    elif algorithm == "mis":
        assert {r["id"]: r["status"] for r in independent_set.independent_set(g, style).collect()} == G.greedy(n, arcs)
    elif algorithm == "pr":
        expected, rounds = G.ranks(n, arcs)
        found, took = rank.pagerank_rounds(g, style=style)
        assert took == rounds and pairs(found) == pytest.approx(expected, abs=1e-12)
    else:
        assert triangles.triangles(g, style).first()[0] == G.triangle_count(n, arcs)


def test_small_and_large_graphs_agree(spark, monkeypatch):
    """The distributed default plans against the one-task solutions, on a graph with a hub and loose ends."""
    from sparkloom.plans import local

    n, arcs = G.random_graph(60, 0.03, 5)
    arcs = sorted({*arcs, *G.both([(7, i) for i in range(30) if i != 7])})
    g = Graph(spark.createDataFrame(arcs, "src long, dst long"), n, directed=False).prepared()
    assert local.fits(g)
    run = lambda: (pairs(relax.bfs(g, 3)), pairs(relax.sssp(g, 3)), pairs(relax.components(g)), sorted(map(tuple, independent_set.independent_set(g, signed=True).collect())), pairs(rank.pagerank(g)))
    small = run()
    assert small[0] == G.distances(n, arcs, 3, False) and small[2] == G.labels(n, arcs)
    monkeypatch.setattr(local, "ARCS", 10)
    large = run()
    assert large[:4] == small[:4] and large[4] == pytest.approx(small[4], abs=1e-12)
    g.free()


def test_long_paths_merge_frontiers(spark, monkeypatch):
    monkeypatch.setattr(relax, "MERGE", 2)
    n, arcs = G.PATH
    g = make(spark, "path")
    assert pairs(relax.sssp(g, 0, Style())) == G.distances(n, arcs, 0, True)


@pytest.mark.parametrize("small", [True, False])
def test_directed_graphs(spark, monkeypatch, small):
    from sparkloom.plans import local

    if not small:
        monkeypatch.setattr(local, "ARCS", 0)
    arrow = Graph(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), 4)
    for style in (None, Style(), Style(flow="pull"), Style("vertex", flow="pull")):
        assert pairs(relax.bfs(arrow, 0, style)) == {0: 0, 1: 1, 2: 2, 3: None}
        assert pairs(relax.bfs(arrow, 1, style)) == {0: None, 1: 0, 2: 1, 3: None}
        assert pairs(relax.components(arrow, style)) == {0: 0, 1: 0, 2: 0, 3: 3}
    ring = Graph(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 2)], "src long, dst long"), 3)
    assert triangles.triangles(ring).first()[0] == triangles.triangles(ring, Style("vertex", reduction="global")).first()[0] == 1
    assert sum(r["status"] == 1 for r in independent_set.independent_set(ring).collect()) == 1
    push, pull = (pairs(rank.pagerank(arrow, style=s)) for s in (None, Style(flow="pull")))
    assert push == pytest.approx(pull) and push[2] > push[1] > push[0]


def test_styles_differ_in_plan(spark):
    """What a style names shows in the plan of its arcs or its step."""
    g = make(spark, "grid").prepared()
    plan = lambda **kw: relax._arcs(g, Style(**kw), False)._jdf.queryExecution().optimizedPlan().toString()
    told = {k: plan(**kw) for k, kw in {"default": {}, "block": {"schedule": "block"}, "cyclic": {"schedule": "cyclic"}, "dynamic": {"schedule": "dynamic"}, "vertex": {"granularity": "vertex"}, "pull": {"flow": "pull"}}.items()}
    strip = lambda p: __import__("re").sub(r"#\d+L?", "", p)
    assert len({strip(p) for p in told.values()}) == len(told)


def test_every_algorithm_has_styles():
    counts = {a: sum(1 for _ in styles(a)) for a in ("bfs", "sssp", "cc", "mis", "pr", "tc")}
    assert all(counts.values())
    with pytest.raises(ValueError):
        Style(flow="sideways")


def test_weights_wrap(spark):
    rows = [(0, 1), (3, 5), (100000, 70000), (50388, 50389)]
    df = spark.createDataFrame(rows, "a long, b long")
    for n in (7, 200000, 50411):
        got = [r[0] for r in df.select(arc_weight(df["a"], df["b"], n)).collect()]
        assert got == [G.weight(a, b, n) for a, b in rows]
    assert G.weight(50388, 50389, 50411) == 0
    ids = spark.range(7)
    assert [r[0] for r in ids.select(priority(ids["id"])).collect()] == [2241873249, 1358751764, 3624587312, 1867592172, 412456688, 2702341812, 1562099570]


def test_builders_and_violations(spark):
    g = from_edges(spark.createDataFrame([(0, 1), (0, 1), (2, 2), (1, 3)], "src long, dst long"))
    assert g.n == 4
    assert {r["check"]: r["violations"] for r in g.violations().collect()} == {"out_of_range": 0, "self_loop": 1, "duplicate": 1, "one_way": 3}
    clean = g.drop_self_loops().symmetrize()
    assert all(r["violations"] == 0 for r in clean.violations().collect())
    assert {r["id"]: r["nbrs"] for r in clean.adjacency().collect()} == {0: [1], 1: [0, 3], 3: [1]}
    assert sorted(map(tuple, from_adjacency(clean.adjacency(), 4).edges.collect())) == [(0, 1), (1, 0), (1, 3), (3, 1)]
    assert {r["id"]: r["degree"] for r in clean.degrees().collect()} == {0: 1, 1: 2, 2: 0, 3: 1}
    with pytest.raises(ValueError):
        relax.bfs(clean, 9)


def test_verifiers_find_faults(spark):
    g = make(spark, "tiny")
    bad = lambda df: sum(r["violations"] for r in df.collect())
    good = relax.bfs(g)
    assert bad(verify.verify_distances(g, good, 0)) == 0
    broken = good.selectExpr("id", "IF(id = 3, 5, dist) AS dist")
    assert bad(verify.verify_distances(g, broken, 0)) > 0
    assert bad(verify.verify_components(g, relax.components(g))) == 0
    assert bad(verify.verify_components(g, spark.range(7).selectExpr("id", "id AS label"))) > 0
    chosen = independent_set.independent_set(g)
    assert bad(verify.verify_independent_set(g, chosen)) == 0
    assert bad(verify.verify_independent_set(g, chosen.selectExpr("id", "1 AS status"))) > 0
    assert verify.differences(good, broken).count() == 1
    assert relax.farthest(good).first().asDict() == {"id": 3, "dist": 2}
    assert relax.farthest(good, sentinel=True).first().asDict() == {"id": 4, "dist": 2147483647}


def test_graph_files(spark, tmp_path):
    from sparkloom.sources.egr import header, read_egr, write_egr

    g = make(spark, "random")
    for graph, name in ((g, "plain"), (g.weighted(), "weighted")):
        path = str(tmp_path / f"{name}.egr")
        write_egr(graph, path)
        assert header(path) == (40, g.edges.count(), name == "weighted")
        back = read_egr(spark, path, slices=3)
        assert back.n == 40
        assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, graph.edges.collect()))
    for n, arcs in ((3, []), (1, [])):
        write_egr(Graph(spark.createDataFrame(arcs, "src long, dst long"), n), str(tmp_path / "bare.egr"))
        assert read_egr(spark, str(tmp_path / "bare.egr")).edges.count() == 0
    with pytest.raises(Exception, match="32 bits"):
        write_egr(Graph(spark.createDataFrame([(0, 1, 1 << 33)], "src long, dst long, weight long"), 2), str(tmp_path / "wide.egr"))
    raw = np.fromfile(path, "=i4")
    raw[:-1].tofile(tmp_path / "short.egr")
    with pytest.raises(ValueError):
        header(str(tmp_path / "short.egr"))


def test_harness(spark):
    from sparkloom.harness import measure

    row = measure(spark, {"tiny": make(spark, "tiny")}, [("bfs", Style())], runs=1, check=True).first()
    assert row["violations"] == 0 and row["arcs"] == 10 and row["gigaedges_per_s"] > 0
