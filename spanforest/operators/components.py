"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .local import FINISH_EDGES, local_rounds
from .state import forget, written


def _stamp(edges: DataFrame) -> tuple[int, int]:
    """The number of edges and an order-free digest of them."""
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return row.n, row.h


def _local(links: DataFrame) -> DataFrame:
    """The components of few links, by one task."""

    def run(batches):
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if parts:
            u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, names, roots = local_rounds(u, v, np.arange(len(u)))
            least = np.full(len(names), np.iinfo(np.int64).max)
            at = np.searchsorted(names, roots)
            np.minimum.at(least, at, names)
            yield pa.record_batch([pa.array(names), pa.array(least[at])], ["vertex", "component"])

    return links.select("u", "v").coalesce(1).mapInArrow(run, "vertex long, component long")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, *, u: str = "u", v: str = "v", finish_edges: int = FINISH_EDGES) -> DataFrame:
    """vertex, component: the smallest vertex that is reachable, for every vertex of an edge.

    `vertices` (one column) adds vertices without edges, each its own component.
    In turns every vertex hangs its larger neighbours, then its smaller ones and
    itself, on the smallest neighbour, until all edges lead to their component's
    smallest vertex; the rounds grow with the logarithm of the vertices. Each
    half round is an aggregate with partial sums and a join, which Spark splits
    where one vertex has many neighbours. Once no more than `finish_edges` links
    are left, one task finishes them (0: never). Edges with a null end are left out.
    """
    links = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    alone = links.filter("u = v").select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    current = written(links.filter("u <> v").distinct(), "links", small=True)
    seen = _stamp(current)
    while seen[0] > finish_edges:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that both sides of the join come straight from a shuffle and Spark splits a hub's rows.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        smaller = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(smaller, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u <> v").distinct()
        following = written(small, "links")
        stamp = _stamp(following)
        forget(current, least, large, smaller)
        current = following
        if stamp == seen:
            break
        seen = stamp
    if 0 < seen[0] <= finish_edges:
        named = _local(current)
        every = named.unionByName(alone)
    else:
        labels = current.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        roots = current.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
        every = labels.unionByName(roots).unionByName(alone)
    if vertices is not None:
        own = vertices.select(F.col(vertices.columns[0]).alias("vertex")).filter("vertex is not null")
        every = every.unionByName(own.select("vertex", F.col("vertex").alias("component")))
    return every.groupBy("vertex").agg(F.min("component").alias("component"))
