import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from spanforest import cli
from spanforest.operators.prepare import dedupe_edges, prepare_edges
from spanforest.plans.metrics import mean_times, scaling_report
from spanforest.sources.edge_list import first_rows, generate_graph, load_graph, read_edges, write_edges
from spanforest.sources.run_log import parse_read_times, parse_run_log, read_run_logs, run_log_lines
from spanforest.streaming.forest import maintain_forest

from .test_graph import kruskal


def test_weighted_text(spark, tmp_path):
    path = tmp_path / "g.edges"
    path.write_text("% a comment\n\n1 2 3.5\n2\t3  4\n3 1 x\n# more\n 7 8\n1e9 2 3\n2 1 0.5 extra words\n")
    got = read_edges(spark, str(path))
    assert [tuple(r)[:3] for r in got.edges.orderBy("line").collect()] == [(1, 2, 3.5), (2, 3, 4.0), (2, 1, 0.5)]
    assert {r.value for r in got.rejects.collect()} == {"3 1 x", " 7 8", "1e9 2 3"}
    first = prepare_edges(got.edges, dedupe="first", order_col="line")
    assert sorted(map(tuple, first.collect())) == [(1, 2, 3.5), (2, 3, 4.0)]
    assert sorted(map(tuple, dedupe_edges(prepare_edges(got.edges)).collect())) == [(1, 2, 0.5), (2, 3, 4.0)]


def test_unweighted_text(spark, tmp_path):
    (tmp_path / "g").write_text("1 2\n2 3\nbad\n")
    got = read_edges(spark, str(tmp_path / "g"), weighted=False, id_offset=1, seed=3)
    rows = got.edges.collect()
    assert {(r.u, r.v) for r in rows} == {(0, 1), (1, 2)} and all(0 <= r.w < 10 for r in rows) and got.rejects.count() == 1


def test_first_keeps_line_order_over_many_splits(spark, tmp_path):
    (tmp_path / "big").write_text("".join(f"{i % 50} {i % 50 + 1} {i}\n" for i in range(20000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        edges = read_edges(spark, str(tmp_path / "big")).edges
        assert edges.rdd.getNumPartitions() > 3
        got = {r.u: r.w for r in prepare_edges(edges, dedupe="first", order_col="line").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i: float(i) for i in range(50)}


@pytest.mark.parametrize("form", ["text", "parquet"])
def test_edges_written_and_read_again(spark, tmp_path, form):
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 5, 1e-9), (3, 9, 12345678.25)], "u long, v long, w double")
    write_edges(edges, str(tmp_path / "out"), form)
    back = read_edges(spark, str(tmp_path / "out")).edges.drop("line") if form == "text" else spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.collect()))
    with pytest.raises(ValueError):
        write_edges(edges, str(tmp_path / "other"), "xml")


@pytest.mark.parametrize(("n", "m"), [(50, 100), (30, 435), (30, 400), (2, 1), (5, 0)])
def test_random_graph(spark, n, m):
    rows = generate_graph(spark, n, m, seed=5).collect()
    assert len(rows) == len({(r.u, r.v) for r in rows}) == m
    assert all(0 <= r.u < r.v < n and 1 <= r.w < 10 for r in rows)
    assert sorted(rows) == sorted(generate_graph(spark, n, m, seed=5).collect())


def test_random_graph_refuses_too_many_edges(spark):
    with pytest.raises(ValueError):
        generate_graph(spark, 3, 4)


def test_source_by_name(spark, tmp_path):
    (tmp_path / "g").write_text("4 9 1.5\n9 4 2\n")
    edges, vertices = load_graph(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in edges.collect()] == [(4, 9, 1.5)] and {r.vertex for r in vertices.collect()} == {4, 9}
    assert load_graph(spark, n=10, m=12)[0].count() == 12


def test_run_logs(spark, tmp_path):
    (tmp_path / "seq").write_text("sequential; read time: 77 usec\nsequential; iters: 6; time: 600 usec\nsequential; iters: 6; time: 800 usec;\n")
    (tmp_path / "pool").write_text("parallel thread; read time: 5 usec\nworkers: 1; iters: 6; time 700 usec\nworkers: 2; iters: 6; time 300 usec;\nworkers: 2; iters: 6; time 400 usec\nnoise\n")
    lines = read_run_logs(spark, {"sequential": str(tmp_path / "seq"), "pool": str(tmp_path / "pool")})
    runs = parse_run_log(lines)
    assert sorted(map(tuple, runs.collect())) == [("pool", 1, 6, 700), ("pool", 2, 6, 300), ("pool", 2, 6, 400), ("sequential", 1, 6, 600), ("sequential", 1, 6, 800)]
    assert sorted(map(tuple, parse_read_times(lines).collect())) == [("parallel thread", 5), ("sequential", 77)]
    means = {(r.engine, r.workers): (r.n, r.mean_usec, r.std_usec) for r in mean_times(runs).collect()}
    assert means["pool", 2] == (2, 350.0, pytest.approx(70.7107, abs=1e-3)) and means["pool", 1] == (1, 700.0, None)
    report = {r.workers: tuple(r)[3:] for r in scaling_report(runs, "sequential").collect()}
    assert report == {1: (1.0, 1.0, 1.0), 2: (2.0, 2.0, 1.0)}
    again = runs.withColumn("workers", F.when(F.col("engine") != "sequential", F.col("workers")))
    assert sorted(map(tuple, parse_run_log(run_log_lines(again)).collect())) == sorted(map(tuple, runs.collect()))


def test_stream_keeps_the_forest(spark, tmp_path):
    rows = [(0, 1, 5.0), (1, 2, 4.0), (0, 2, 1.0), (3, 4, 2.0), (2, 3, 9.0), (1, 3, 3.0), (0, 1, 0.5)]
    source = tmp_path / "in"
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], "u long, v long, w double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("u long, v long, w double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = maintain_forest(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    assert last >= 2 and sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / f"batch={last}")).collect())) == kruskal(rows)[0]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["--nodes", "30", "--edges", "60", "--iters", "2", "--out", str(tmp_path / "forest")]) == 0
    said = capsys.readouterr().out
    assert "edges: 60" in said and said.count("iters:") == 2 and spark.read.parquet(str(tmp_path / "forest")).count() > 20
    assert said.count("stage rounds:") == 2
    for wrong in (["--nodes", "many"], ["--workers", "1,x"]):
        with pytest.raises(SystemExit) as stop:
            cli.main(wrong)
        assert stop.value.code != 0


def test_sweep_over_workers_writes_a_log(spark, tmp_path):
    """In a process of its own, as each number of workers has its own session."""
    log = tmp_path / "runs.log"
    done = subprocess.run([sys.executable, "-m", "spanforest.cli", "--nodes", "20", "--edges", "40", "--iters", "2", "--workers", "1,2", "--log", str(log)], capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    lines = read_run_logs(spark, {"spark": str(log)})
    runs = parse_run_log(lines)
    assert sorted((r.workers, r.n) for r in mean_times(runs).collect()) == [(1, 2), (2, 2)] and parse_read_times(lines).count() == 2
    alone = runs.filter("workers = 1").withColumn("engine", F.lit("sequential"))
    report = scaling_report(runs.unionByName(alone), "sequential").collect()
    assert sorted(r.workers for r in report) == [1, 2] and all(r.speedup > 0 for r in report)



@pytest.mark.parametrize("n", [0, 1, 499, 500, 1000, 2000])
def test_first_rows(spark, n):
    df = spark.range(1000, numPartitions=7).withColumn("k", F.xxhash64("id") % 40)
    rows = first_rows(df, F.col("k"), n)
    got = [r.k for r in rows.collect()]
    assert rows.columns == ["id", "k"] and sorted(got) == sorted(r.k for r in df.collect())[:n]
