import random
import threading
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from spanforest.functions.edges import jittered, uniform
from spanforest.operators import local, prepare, rounds
from spanforest.operators.components import connected_components
from spanforest.operators.forest import forest_weight, minimum_spanning_forest, tree_weight
from spanforest.operators.state import forget, swept, written

F1 = [(0, 1, 1.0), (2, 3, 1.1), (4, 5, 1.2), (0, 2, 3.0), (3, 5, 4.0), (1, 4, 7.0)]
F2 = [(0, 1, 1.0), (2, 3, 1.1), (4, 5, 1.2), (6, 7, 1.3), (0, 2, 2.0), (4, 6, 2.5), (0, 4, 9.0)]
#: edges, forest, components, rounds
FIXTURES = {
    "least edge of a component and not of a vertex": (F1, [e for e in F1 if e[:2] != (1, 4)], 1, 2),
    "no early stop": (F2, F2, 1, 3),
    "heavy edges": ([(0, 1, 10.0), (1, 2, 25.0), (0, 2, 30.0)], [(0, 1, 10.0), (1, 2, 25.0)], 1, 1),
    "two components": ([(0, 1, 1.0), (2, 3, 2.0)], [(0, 1, 1.0), (2, 3, 2.0)], 2, 1),
    "no edges": ([], [], 0, 0),
    "ties": ([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0)], [(0, 1, 1.0), (0, 2, 1.0)], 1, 1),
    "a loop and sparse ids": ([(5, 5, 1.0), (5, 9, 2.0)], [(5, 9, 2.0)], 1, 1),
    "parallel edges": ([(0, 1, 5.0), (1, 0, 3.0)], [(0, 1, 3.0)], 1, 1),
    "large ids, weights of any sign": ([(1000000007, 4000000000, -2.0), (4000000000, 7, 0.0)], [(1000000007, 4000000000, -2.0), (7, 4000000000, 0.0)], 1, 1),
}


def edges_of(spark, rows, kind="double"):
    return spark.createDataFrame([(u, v, w) for u, v, w in rows], "u long, v long, w double").withColumn("w", F.col("w").cast(kind))


def kruskal(rows):
    simple = {}
    for u, v, w in rows:
        if u != v:
            k = (min(u, v), max(u, v))
            simple[k] = min(w, simple.get(k, w))
    up = {x: x for k in simple for x in k}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for w, u, v in sorted((w, u, v) for (u, v), w in simple.items()):
        a, b = find(u), find(v)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((u, v, w))
    return sorted(out), {x: find(x) for x in up}


def found(result):
    return sorted((r.u, r.v, r.w) for r in result.edges.collect()), {r.vertex: r.component for r in result.labels.collect()}


@pytest.mark.parametrize("finish", [0, local.FINISH_EDGES])
@pytest.mark.parametrize("name", FIXTURES)
def test_fixtures(spark, name, finish):
    rows, forest, components, many = FIXTURES[name]
    result = minimum_spanning_forest(prepare.prepare_edges(edges_of(spark, rows)), finish_edges=finish)
    got, labels = found(result)
    assert got == sorted((min(u, v), max(u, v), w) for u, v, w in forest)
    assert len(set(labels.values())) == components and all(c <= v for v, c in labels.items())
    trace = sorted(result.trace.collect())
    assert [r.round for r in trace] == list(range(1, many + 1)) and sum(r.chosen_edges for r in trace) == len(forest)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_against_kruskal(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([10, 60, 300])
    rows = [(rng.randrange(n) * 7919, rng.randrange(n) * 7919, float(rng.choice([rng.randrange(5), rng.random()]))) for _ in range(rng.choice([n // 2, 3 * n]))]
    want = kruskal(rows)
    flipped = [(v, u, w) for u, v, w in rows]
    rng.shuffle(flipped)
    traces = []
    for own, finish, parts in ((rows, 0, 3), (flipped, local.FINISH_EDGES, 7), (rows, n, 5)):
        result = minimum_spanning_forest(prepare.prepare_edges(edges_of(spark, own).repartition(parts)), finish_edges=finish)
        assert found(result) == want
        assert len(want[0]) == len(want[1]) - len(set(want[1].values()))
        traces.append(sorted(map(tuple, result.trace.collect())))
    assert traces[0] == traces[1] == traces[2]
    weight = forest_weight(result.edges).first()
    assert weight.edges == len(want[0]) and weight.weight == pytest.approx(sum(w for *_, w in want[0]), rel=1e-9)


def test_weights_below_a_cent_and_wide_decimals(spark):
    path = edges_of(spark, [(i, i + 1, 0.004) for i in range(100)])
    assert tuple(forest_weight(path).first()) == (100, pytest.approx(0.4, rel=1e-9))
    fine = edges_of(spark, [(i, i + 1, 0.0) for i in range(3)]).withColumn("w", F.lit("0.000000123456").cast("decimal(20,12)"))
    assert forest_weight(fine).first().weight == pytest.approx(3 * 0.000000123456, rel=1e-9)
    assert tuple(forest_weight(path.limit(0)).first()) == (0, 0.0)


def folders(spark):
    return {p.name for p in Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path).iterdir()}


def test_only_what_results_read_stays(spark):
    rng = random.Random(12)
    edges = written(prepare.prepare_edges(edges_of(spark, [(rng.randrange(300), rng.randrange(300), rng.random()) for _ in range(900)])), "edges")
    before = folders(spark)
    result = minimum_spanning_forest(edges, finish_edges=0)
    rounds_ = result.trace.count()
    made = sorted(n.split("-")[0] for n in folders(spark) - before)
    assert rounds_ > 2 and made == sorted(["ranked", "finished", "labels", *["chosen"] * rounds_])
    assert result.edges.count() == len(kruskal([tuple(r) for r in edges.collect()])[0])
    with swept(spark) as kept:
        kept.append(written(minimum_spanning_forest(edges, finish_edges=0).edges, "result"))
    assert kept[0].count() == result.edges.count() and [n.split("-")[0] for n in folders(spark) - before if n.split("-")[0] not in made] == ["result"]


def test_threads_sweep_their_own_tables(spark):
    held, swept_once = threading.Event(), threading.Event()
    found = []

    def reads():
        table = written(spark.range(5), "other")
        held.set()
        swept_once.wait(60)
        found.append(table.count())

    with swept(spark):
        other = threading.Thread(target=reads)
        other.start()
        assert held.wait(60)
        gone = written(spark.range(3), "own")
    swept_once.set()
    other.join(60)
    assert found == [5]
    with pytest.raises(Exception):  # noqa: B017
        gone.count()


def test_forest_of_a_union_is_the_forest_of_forests(spark):
    rng = random.Random(8)
    a, b = ([(rng.randrange(40), rng.randrange(40), rng.random()) for _ in range(90)] for _ in range(2))
    parts = [kruskal(x)[0] for x in (a, b)]
    assert found(minimum_spanning_forest(prepare.prepare_edges(edges_of(spark, parts[0] + parts[1])))) [0] == kruskal(a + b)[0]


def test_isolated_vertices_and_decimal_weights(spark):
    result = minimum_spanning_forest(prepare.prepare_edges(edges_of(spark, F1, "decimal(18,2)")), spark.createDataFrame([(0,), (99,), (None,)], "id long"))
    assert {r.vertex: r.component for r in result.labels.collect()}[99] == 99
    assert dict(result.edges.dtypes)["w"] == "decimal(18,2)"


@pytest.mark.parametrize("finish", [0, local.FINISH_EDGES])
def test_components(spark, finish):
    rng = random.Random(3)
    rows = [(i, i + 1, 0.0) for i in range(100, 400)] + [(7, 1000 + i, 0.0) for i in range(300)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200), 0.0) for _ in range(120)] + [(9, 9, 0.0)]
    want = kruskal(rows)[1] | {9: 9} | {u: kruskal(rows)[1].get(u, u) for u, v, _ in rows if u == v}
    got = connected_components(edges_of(spark, rows).repartition(6), spark.createDataFrame([(7,), (8,)], "x long"), finish_edges=finish)
    assert {r.vertex: r.component for r in got.collect()} == want | {8: 8}
    nulls = spark.createDataFrame([(1, None), (None, 2)], "u long, v long")
    assert connected_components(nulls, finish_edges=finish).count() == 0


def test_single_steps(spark):
    edges = prepare.prepare_edges(edges_of(spark, F1))
    ranked = prepare.ranked_edges(edges)
    order = [(r.w, r.u, r.v) for r in ranked.orderBy("rid").collect()]
    assert order == sorted(order)
    best = {r.vertex: (r.u, r.v) for r in rounds.min_edge_per_vertex(edges).collect()}
    assert best == {0: (0, 1), 1: (0, 1), 2: (2, 3), 3: (2, 3), 4: (4, 5), 5: (4, 5)}
    rng = random.Random(5)
    ties = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(3))) for _ in range(200)]
    by_rank = prepare.ranked_edges(prepare.prepare_edges(edges_of(spark, ties)))
    first = rounds.best_edges(by_rank.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "rid")).join(by_rank, "rid").select("component", "u", "v", "w")
    assert sorted(map(tuple, rounds.min_edge_per_vertex(prepare.prepare_edges(edges_of(spark, ties))).collect())) == sorted(map(tuple, first.collect()))
    labels = rounds.first_round(edges)
    assert {r.vertex: r.component for r in labels.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
    assert {r.component for r in rounds.component_roots(labels).collect()} == {0, 2, 4}
    left = rounds.filter_edges(ranked.select("u", "v", "w"), labels)
    assert {(r.u, r.v, r.cu, r.cv) for r in left.collect()} == {(0, 2, 0, 2), (3, 5, 2, 4), (1, 4, 0, 4)}


def test_preparation(spark):
    raw = spark.createDataFrame([(0, 1, 5.0, 1), (1, 0, 3.0, 2), (2, 2, 1.0, 3), (None, 1, 1.0, 4), (1, None, 1.0, 5), (3, 4, None, 6), (3, 4, float("nan"), 7), (9, 4, 2.0, 8)], "a long, b long, c double, n int")
    assert sorted(map(tuple, prepare.prepare_edges(raw, "a", "b", "c").collect())) == [(0, 1, 3.0), (4, 9, 2.0)]
    assert sorted(map(tuple, prepare.prepare_edges(raw, "a", "b", "c", dedupe="first", order_col="n").collect())) == [(0, 1, 5.0), (4, 9, 2.0)]
    assert sorted(map(tuple, prepare.clean_edges(raw, "a", "b", "c", id_offset=1).collect())) == [(-1, 0, 3.0), (-1, 0, 5.0), (3, 8, 2.0)]
    with pytest.raises(ValueError):
        prepare.dedupe_edges(raw, "last")
    edges = prepare.prepare_edges(raw, "a", "b", "c")
    assert tuple(prepare.graph_counts(edges).first()) == (4, 2, 4)
    assert sorted(map(tuple, prepare.symmetric_edges(edges).collect())) == [(0, 1, 3.0), (1, 0, 3.0), (4, 9, 2.0), (9, 4, 2.0)]
    assert [tuple(r)[:2] for r in prepare.sorted_edges(edges).collect()] == [(0, 1), (4, 9)]
    assert tree_weight(spark.createDataFrame([(1, 0), (7, 8)], "a long, b long"), edges).first().weight == 3.0


def test_random_weights(spark):
    df = spark.range(1000).select(uniform(2, 3, 5).alias("x"), jittered(F.lit(10.0), 6).alias("y"))
    low = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert 2 <= low[0] < low[1] < 3 and 9 <= low[2] < low[3] < 11


def test_plans(spark):
    """Lightest edges are hash aggregates, and nothing is dealt to one partition or joined as a product."""
    ranked = prepare.ranked_edges(prepare.prepare_edges(edges_of(spark, F1)))
    live = ranked.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "rid")
    best = rounds.best_edges(live)
    for df in (best, rounds.relabelled(live, written(rounds.contract(live, best), "roots"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_single_step_is_one_shuffle(spark):
    edges = written(prepare.prepare_edges(edges_of(spark, F1)), "edges")
    plan = rounds.min_edge_per_vertex(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "rangepartitioning" not in plan


def test_forgotten_tables_are_gone(spark):
    table = written(spark.range(3), "x")
    assert table.count() == 3
    forget(table, spark.range(2))
    with pytest.raises(Exception):  # noqa: B017
        table.count()
