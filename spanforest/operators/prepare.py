"""From raw edges to a simple graph with a total order on its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edges import rebased
from .state import written


def clean_edges(df: DataFrame, src: str = "u", dst: str = "v", weight: str = "w", *keep: str, id_offset: int = 0) -> DataFrame:
    """u, v, w with u < v: one row for each usable row. Loops and rows with a null end or a null or NaN weight go."""
    u, v, w = F.col(src).cast("bigint") - id_offset, F.col(dst).cast("bigint") - id_offset, F.col(weight)
    usable = df.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & w.isNotNull() & ~F.isnan(w.cast("double")) & (F.col(src) != F.col(dst)))
    return usable.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), w.alias("w"), *(F.col(k) for k in keep))


def rebased_edges(edges: DataFrame, id_offset: int) -> DataFrame:
    """Every edge as it stands, loops and larger first ends too, with ids that begin elsewhere."""
    return edges.withColumns({end: rebased(F.col(end), id_offset) for end in ("u", "v")})


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """src, dst, w: each edge in both directions, in one pass over the edges."""
    both = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return edges.select(both.alias("e"), "w").select("e.src", "e.dst", "w")


def dedupe_edges(edges: DataFrame, how: str = "min", order_col: str | None = None) -> DataFrame:
    """One row for each pair: the lightest edge, or (`first`) the one with the smallest order."""
    if how == "min":
        return edges.groupBy("u", "v").agg(F.min("w").alias("w"))
    if how == "first" and order_col:
        return edges.groupBy("u", "v").agg(F.min_by("w", order_col).alias("w"))
    raise ValueError("how is 'min', or 'first' with an order column")


def prepare_edges(df: DataFrame, src: str = "u", dst: str = "v", weight: str = "w", *, dedupe: str = "min", order_col: str | None = None, id_offset: int = 0) -> DataFrame:
    keep = [order_col] if dedupe == "first" and order_col else []
    return dedupe_edges(clean_edges(df, src, dst, weight, *keep, id_offset=id_offset), dedupe, order_col)


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("u", "v", "w")


def graph_counts(edges: DataFrame) -> DataFrame:
    """vertices, edges, directed_edges in one row."""
    n = edges.agg(F.count("*").alias("edges"))
    return vertices_of(edges).agg(F.count("*").alias("vertices")).crossJoin(n).select("vertices", "edges", (2 * F.col("edges")).alias("directed_edges"))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Adds `rid`, whose order is that of (w, u, v), a null weight last.

    A range shuffle sorts the edges; ids that grow with partition and row then
    keep the order without numbering through one task. They are written at
    once, as they must not be drawn anew.
    """
    return written(edges.select("u", "v", "w").orderBy(F.col("w").asc_nulls_last(), "u", "v").withColumn("rid", F.monotonically_increasing_id()), "ranked")
