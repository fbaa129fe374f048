"""The steps of a round: lightest edges, contraction, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import forget, written


def best_edges(live: DataFrame) -> DataFrame:
    """component, rid: the first edge in order that leaves each component of live(cu, cv, rid).

    The smallest of one long column is a hash aggregate with partial sums, so a
    component with most of the edges costs one row a task.
    """
    return live.select(F.explode(F.array("cu", "cv")).alias("component"), "rid").groupBy("component").agg(F.min("rid").alias("rid"))


def lightest(edges: DataFrame) -> DataFrame:
    """vertex, u, v, w: the first edge at each vertex of (u, v, w) in the order (w, u, v), a null weight last.

    Edges stand as they were given: either end may be the larger one, and a loop
    is an edge at its vertex. One aggregate with partial sums: nothing is ranked
    or joined, and a hub is one row a task.
    """
    both = edges.select(F.explode(F.array("u", "v")).alias("vertex"), F.struct(F.col("w").isNull().alias("last"), "w", "u", "v").alias("e"))
    return both.groupBy("vertex").agg(F.min("e").alias("e")).select("vertex", "e.u", "e.v", "e.w")


def min_edge_per_vertex(edges: DataFrame) -> DataFrame:
    """vertex, u, v, w: the lightest edge at each vertex, ties by (u, v)."""
    return lightest(edges)


def contract(live: DataFrame, best: DataFrame) -> DataFrame:
    """component, root: where each component of live(cu, cv, rid) goes when its best edge is taken."""
    return settled(best.join(live, "rid").select("component", F.when(F.col("component") == F.col("cu"), F.col("cv")).otherwise(F.col("cu")).alias("root")))


def settled(hook: DataFrame) -> DataFrame:
    """component, root: the end of the way from each component over hook(component, root), written.

    Each component points to the other end of its best edge. Under a total order
    the only rings are pairs that point to each other, and there the smaller id
    stays; then every pointer is replaced by its target's until all are roots,
    which doubles their reach each time.
    """
    hook = written(hook, "hooks")
    back = hook.select(F.col("component").alias("root"), F.col("root").alias("again"))
    mutual = (F.col("again") == F.col("component")) & (F.col("component") < F.col("root"))
    pointer = written(hook.join(back, "root").select("component", F.when(mutual, F.col("component")).otherwise(F.col("root")).alias("root"), F.lit(True).alias("moved")), "pointers")
    forget(hook)
    while not pointer.filter("moved").isEmpty():
        target = pointer.select(F.col("component").alias("root"), F.col("root").alias("beyond"))
        jumped = written(pointer.join(target, "root").select("component", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved")), "pointers")
        forget(pointer)
        pointer = jumped
    roots = pointer.select("component", "root")
    roots._written_to = pointer._written_to
    return roots


def relabelled(live: DataFrame, roots: DataFrame) -> DataFrame:
    """live(cu, cv, rid) between the new components: edges inside one go, and of parallel ones the first in order stays."""
    one = live.join(roots.select(F.col("component").alias("cu"), F.col("root").alias("a")), "cu")
    both = one.join(roots.select(F.col("component").alias("cv"), F.col("root").alias("b")), "cv").filter("a <> b")
    return both.select(F.least("a", "b").alias("cu"), F.greatest("a", "b").alias("cv"), "rid").groupBy("cu", "cv").agg(F.min("rid").alias("rid"))


def filter_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges (all columns) whose ends lie in different components of labels(vertex, component), with cu and cv."""
    one = edges.join(labels.select(F.col("vertex").alias("u"), F.col("component").alias("cu")), "u")
    return one.join(labels.select(F.col("vertex").alias("v"), F.col("component").alias("cv")), "v").filter("cu <> cv").select(*edges.columns, "cu", "cv")


def component_roots(labels: DataFrame) -> DataFrame:
    return labels.select("component").distinct()


def smallest_names(labels: DataFrame) -> DataFrame:
    """labels(vertex, component) with each component named by its smallest vertex."""
    least = labels.groupBy("component").agg(F.min("vertex").alias("least"))
    return labels.join(least, "component").select("vertex", F.col("least").alias("component"))


def first_round(edges: DataFrame) -> DataFrame:
    """labels(vertex, component) after one round over (u, v, w)."""
    other = F.when(F.col("vertex") == F.col("u"), F.col("v")).otherwise(F.col("u"))
    roots = settled(lightest(edges).select(F.col("vertex").alias("component"), other.alias("root")))
    return smallest_names(roots.select(F.col("component").alias("vertex"), F.col("root").alias("component")))
