"""Minimum spanning forests by rounds of lightest edges."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .local import FINISH_EDGES, local_rounds
from .prepare import ranked_edges, vertices_of
from .rounds import best_edges, contract, relabelled, smallest_names
from .state import forget, written

class ForestResult(NamedTuple):
    edges: DataFrame  # u, v, w, round
    labels: DataFrame  # vertex, component
    trace: DataFrame  # round, live_edges, components, chosen_edges


def _finished(live: DataFrame, done: int) -> DataFrame:
    """kind, a, b, c: rows (0, rid, round), (1, component, root), (2, round, live edges, components) of the rounds that are left."""

    def run(batches):
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not parts:
            return
        cu, cv, rid = (np.concatenate(x) for x in zip(*parts, strict=True))
        rounds, names, roots = local_rounds(cu, cv, rid)
        for k, r in enumerate(rounds, done + 1):
            n = len(r.chosen)
            yield pa.record_batch([pa.array(np.zeros(n, np.int64)), pa.array(r.chosen), pa.array(np.full(n, k)), pa.array(np.zeros(n, np.int64))], ["kind", "a", "b", "c"])
            yield pa.record_batch({"kind": pa.array([2], pa.int64()), "a": pa.array([k], pa.int64()), "b": pa.array([r.live_edges], pa.int64()), "c": pa.array([r.components], pa.int64())})
        n = len(names)
        yield pa.record_batch([pa.array(np.ones(n, np.int64)), pa.array(names), pa.array(roots), pa.array(np.zeros(n, np.int64))], ["kind", "a", "b", "c"])

    return live.select("cu", "cv", "rid").coalesce(1).mapInArrow(run, "kind long, a long, b long, c long")


def minimum_spanning_forest(edges: DataFrame, vertices: DataFrame | None = None, *, finish_edges: int = FINISH_EDGES) -> ForestResult:
    """The minimum spanning forest of a graph (u, v, w), unique under the order (w, u, v), a null weight last.

    Either end may be the larger one, and a pair may stand there in both
    directions. A loop is live in the first round, as an edge at its vertex, and never in the forest.

    Each round takes every component's first edge and contracts; what is left
    between components shrinks to less than half the components, and parallel
    edges go. While more than `finish_edges` are left a round is joins and
    aggregates over the cluster; the rest, whose size is known then, is finished
    by one task with the same rounds over arrays. `vertices` (one column) adds
    vertices without edges.
    """
    spark = edges.sparkSession
    ranked = ranked_edges(edges)
    live, left, done = ranked.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "rid"), ranked.count(), 0
    chosen, traces, labels = [], [], None
    while left > finish_edges:
        done += 1
        best = written(best_edges(live), "best")
        chosen.append(written(best.select("rid").distinct().withColumn("round", F.lit(done)), "chosen"))
        counted = best.agg(F.count("*").alias("components"), F.countDistinct("rid").alias("chosen")).first()
        traces.append((done, left, counted.components, counted.chosen))
        roots = contract(live, best)
        step = roots.select(F.col("component").alias("c"), "root")
        older = labels
        if labels is None:
            labels = written(roots.select(F.col("component").alias("vertex"), F.col("root").alias("component")), "labels")
        else:
            labels = written(labels.join(step, F.col("component") == F.col("c"), "left").select("vertex", F.coalesce("root", "component").alias("component")), "labels")
        following = written(relabelled(live, roots), "live")
        left = following.count()
        forget(*(t for t in (live, best, roots, older) if t is not None))
        live = following
    rest = written(_finished(live, done), "finished")
    forget(live)  # does nothing before the first round, where these are the ranked edges under other names
    chosen.append(rest.filter("kind = 0").select(F.col("a").alias("rid"), F.col("b").cast("int").alias("round")))
    step = rest.filter("kind = 1").select(F.col("a").alias("c"), F.col("b").alias("root"))
    labels = step.select(F.col("c").alias("vertex"), F.col("root").alias("component")) if labels is None else labels.join(step, F.col("component") == F.col("c"), "left").select("vertex", F.coalesce("root", "component").alias("component"))
    every = chosen[0]
    for more in chosen[1:]:
        every = every.unionByName(more)
    forest = ranked.filter("u <> v").join(every, "rid").select("u", "v", "w", F.col("round").cast("int").alias("round"))
    labels = smallest_names(labels)
    if vertices is not None:
        own = vertices.select(F.col(vertices.columns[0]).cast("bigint").alias("vertex")).filter("vertex is not null").distinct()
        alone = own.join(vertices_of(edges), "vertex", "left_anti")
        labels = labels.unionByName(alone.select("vertex", F.col("vertex").alias("component")))
    each = rest.filter("kind = 0").groupBy("b").agg(F.count("*").alias("n")).select(F.col("b").alias("round"), F.col("n"))
    trace = rest.filter("kind = 2").select(F.col("a").alias("round"), F.col("b").alias("live_edges"), F.col("c").alias("components")).join(each, "round").select(F.col("round").cast("int").alias("round"), "live_edges", "components", F.col("n").alias("chosen_edges"))
    if traces:
        trace = spark.createDataFrame(traces, "round int, live_edges long, components long, chosen_edges long").unionByName(trace)
    return ForestResult(forest, labels, trace)


def forest_weight(forest: DataFrame) -> DataFrame:
    """edges and weight of a forest: decimals are summed at their own scale, other numbers as doubles."""
    w = F.col("w") if dict(forest.dtypes)["w"].startswith("decimal") else F.col("w").cast("double")
    return forest.agg(F.count("*").alias("edges"), F.coalesce(F.sum(w).cast("double"), F.lit(0.0)).alias("weight"))


def tree_weight(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The total weight of the edges that join given pairs (a, b), in whichever direction they are given."""
    ends = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return forest_weight(edges.join(ends, ["u", "v"]))
