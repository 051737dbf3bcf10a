import duckdb
import pytest

import __spark_entry__
from sparkloom import queries as core
from sparkloom.operators import results
from sparkloom.sources.results import append_results, read_logs, read_results
from sparkloom.sources.sample import SAMPLE_LOG, sample_results


def same(a, b):
    """Rows of both, columns by name, in one order."""
    cell = lambda v: None if v is None or v != v else (round(v, 9) if isinstance(v, float) else v)
    rows = lambda df: sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", [n for n in core.oracle_sql() if n.startswith("results_")])
def test_result_queries_match_sql(spark, name):
    found = core.queries()[name](spark, "").toPandas()
    assert len(found)
    same(found, duckdb.connect().execute(core.oracle_sql()[name]).df())


def test_all_queries_have_sql_but_the_style_count():
    assert set(core.queries()) - set(core.oracle_sql()) == {"style_counts"}
    assert set(core.oracle_sql()) <= set(__spark_entry__.queries())


def test_logs_and_csv(spark, tmp_path):
    log = tmp_path / "a.out"
    log.write_text("\n".join(SAMPLE_LOG) + "\n")
    found = read_logs(spark, str(log), "x_")
    assert sorted((r["program"], r["throughput"]) for r in found.collect() if r["throughput"]) == [("x_alpha_CPP.cpp", 1.5), ("x_gamma_CPP.cpp", 2.25)]
    assert found.count() == 3
    for _ in range(2):
        append_results(found, str(tmp_path / "out"), "bfs")
    assert read_results(spark, str(tmp_path / "out"), "bfs").count() == 6
    big = tmp_path / "big.out"
    big.write_text("".join(f"compile : p{i}.cpp\nThroughput: {i}.5 gigaedges/s\n" for i in range(2_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_logs(spark, str(big)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["program"]: r["throughput"] for r in rows} == {f"p{i}.cpp": i + 0.5 for i in range(2_000)}
    (tmp_path / "b.csv").write_text('"filename","bfs"\n"one.cpp\n","2.5"\n')
    assert [tuple(r) for r in read_results(spark, str(tmp_path / "b.csv"), "bfs").collect()] == [("one.cpp", 2.5)]


def test_tags_of_odd_names(spark):
    names = ["_32_rmat_PR-Push_FloatType_Reduction_Cyclic.cpp", "_32_2d_pr-push_FloatType_Critical_Block_Determin.cpp", "2d_3090TC_E_Warp_Persist_BlockAdd_IntType_CudaAtomic.cu", "omp_32_2d_BFS_OMP_E_Data_IntType_NonDeterm_Default_Atomic_ReadWrite.cpp\n"]
    rows = results.parse_tags(spark.createDataFrame([(n, 1.0) for n in names], "filename string, throughput double")).collect()
    assert (rows[0]["algorithm"], rows[0]["flow"], rows[0]["reduction"], rows[0]["schedule"], rows[0]["unit"]) == ("PR", "Push", "Reduction", "Cyclic", None)
    assert (rows[1]["algorithm"], rows[1]["flow"], rows[1]["determinism"], rows[1]["graph"]) == ("PR", "Push", "Determ", "2d")
    assert (rows[2]["algorithm"], rows[2]["model"], rows[2]["unit"], rows[2]["atomics"], rows[2]["persistence"]) == ("TC", "CUDA", "Warp", "CudaAtomic", "Persist")
    assert (rows[3]["determinism"], rows[3]["update"], rows[3]["worklist"]) == ("NonDeterm", "ReadWrite", None)


def test_figures_run(spark):
    tagged = results.parse_tags(sample_results(spark))
    for axis, over, under in results.FIGURES.values():
        results.quantile_summary(results.ratios(tagged, axis, over, under)).collect()
    assert len(results.pivoted(results.style_matrix(tagged), "median_ratio").columns) == 21
