"""Tables as larger scales or careless writers make them: keys that overlap, equal, missing and repeated values."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from spanforest.operators.forest import minimum_spanning_forest
from spanforest.operators.nearest import nearest_edges
from tests.test_entry import plain
from tests.test_graph import edges_of, folders, kruskal


def equal_to_sql(spark, folder, name):
    own = duckdb.connect()
    for path in folder.iterdir():
        own.execute(f"create view {path.stem} as select * from '{path}'")
    got = entry.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    want = own.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name].strip()})").fetchall()
    assert want
    assert plain(got.select(*columns).collect()) == plain(want)


SUPPLIERS = {
    "copies": [(i, float(i * 7 % 10)) for i in range(40)],
    "one place": [(i, 2.5) for i in range(9)],
    "missing places": [(i, None if i % 4 == 1 else float(i * 5 % 7)) for i in range(24)],
    "missing first": [(i, None if i in (0, 3) else float(-i * i % 11)) for i in range(14)],
    "no places": [(i, None) for i in range(6)],
    "repeated keys": [(i % 9, [0.0, 4.25, -3.5, None, 4.25, 1.0, 9.75][i % 7]) for i in range(26)],
    "missing keys": [(None, 1.0), (1, 1.0), (2, None), (None, None), (3, -2.0)],
}


@pytest.mark.parametrize("case", SUPPLIERS)
def test_supplier_forest_equals_sql(spark, tmp_path, case):
    pq.write_table(pa.table({"s_suppkey": pa.array([k for k, _ in SUPPLIERS[case]], pa.int64()), "s_acctbal": pa.array([b for _, b in SUPPLIERS[case]], pa.float64())}), tmp_path / "supplier.parquet")
    equal_to_sql(spark, tmp_path, "spanning_forest_supplier")


@pytest.mark.parametrize("seed", range(2))
def test_nearest_edges_hold_the_forest_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    points = [(k * 31 % 211, rng.randrange(90 * (seed + 1)) / 4) for k in range(200)]
    edges = nearest_edges(spark.createDataFrame(points, "k long, b double").repartition(5))
    want = kruskal([(a, b, abs(x - y)) for i, (a, x) in enumerate(points) for b, y in points[i + 1 :]])[0]
    assert sorted((r.u, r.v, r.w) for r in minimum_spanning_forest(edges).edges.collect()) == want


def test_supplier_forest_makes_no_pairs(spark, tmp_path):
    """As many edges are ranked as there are points, not one for each of 4.5 million pairs."""
    pq.write_table(pa.table({"s_suppkey": pa.array(range(3000), pa.int64()), "s_acctbal": pa.array([i * 37 % 1000 / 100 for i in range(3000)], pa.float64())}), tmp_path / "supplier.parquet")
    before = folders(spark)
    assert entry.queries()["spanning_forest_supplier"](spark, str(tmp_path)).count() == 2999
    shared = spark.conf.get("spark.checkpoint.dir")
    assert [spark.read.parquet(f"{shared}/{n}").count() for n in folders(spark) - before if n.startswith("ranked")] == [2999]


@pytest.fixture(scope="module")
def overlapping(tmp_path_factory):
    """Parts and suppliers whose numbers in the graph are the same: loops, edges in both directions, larger ends first."""
    folder, rng = tmp_path_factory.mktemp("overlapping"), random.Random(4)
    rows = [(1_000_000 + rng.randrange(-6, 14), rng.randrange(9), rng.randrange(1, 9) * 400.0) for _ in range(260)] + [(1_000_200, 200, 5.0), (1_000_003, 3, 1.0), (1_000_003, 30, None)]
    own = pa.table({"l_orderkey": pa.array(range(len(rows)), pa.int64()), "l_linenumber": pa.array([1] * len(rows), pa.int32()), "l_partkey": pa.array([r[0] for r in rows], pa.int64()), "l_suppkey": pa.array([r[1] for r in rows], pa.int64()), "l_extendedprice": pa.array([r[2] for r in rows], pa.float64())})
    pq.write_table(own, folder / "lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["edges_rebased", "min_edge_per_vertex", "contract_round1", "filter_edges_round1", "component_roots_round1", "spanning_forest_part_supplier", "forest_weight_sparse", "components", "component_sizes", "connected_pairs", "round_trace_first", "edges_sorted", "vertices"])
def test_overlapping_ids_equal_sql(spark, overlapping, name):
    equal_to_sql(spark, overlapping, name)


@pytest.mark.parametrize("finish", [0, 10**6])
def test_edges_as_they_stand(spark, finish):
    """Loops and edges in both directions, in rounds on the cluster and in one task."""
    rng = random.Random(6)
    edges = sorted({(rng.randrange(25), rng.randrange(25)): float(rng.randrange(6)) for _ in range(70)}.items(), key=lambda e: (e[1], e[0]))
    edges += [((99, 99), 0.0)]
    up, want = {x: x for pair, _ in edges for x in pair}, []
    for (u, v), w in sorted(edges, key=lambda e: (e[1], e[0])):
        if up[u] != up[v]:
            want.append((u, v, w))
            up = {x: min(up[u], up[v]) if c in (up[u], up[v]) else c for x, c in up.items()}
    result = minimum_spanning_forest(edges_of(spark, [(u, v, w) for (u, v), w in edges]), finish_edges=finish)
    assert sorted(map(tuple, result.edges.select("u", "v", "w").collect())) == sorted(want)
    assert {r.vertex: r.component for r in result.labels.collect()} == up
