"""The complete graph over points of a line, cut down to the edges its minimum spanning forest can have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prepare import dedupe_edges
from .state import written


def nearest_edges(points: DataFrame) -> DataFrame:
    """u, v, w: of the edges between all points(k, b), with w the distance of their b, those that can be in the minimum spanning forest.

    An edge that is the last of a ring in the order (w, u, v) is in no such
    forest, and each one left out is: between points of one place the edges from
    the smallest k come first; between places that are neighbours, the one of
    their smallest k does; and between others, all steps from place to place
    are shorter. So there are about as many edges as points instead of one for
    each pair. A point without place has edges without weight, which come last
    and of which those of the smallest k of all are first. Points without k
    have no edges; a k may have several places.
    """
    points = points.select("k", "b").filter("k is not null").distinct()
    placed = points.filter("b is not null")
    places = written(placed.groupBy("b").agg(F.min("k").alias("least")).orderBy("b").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "places")
    star = placed.join(places, "b").select(F.col("least").alias("u"), F.col("k").alias("v"), F.abs(F.col("b") - F.col("b")).alias("w"))
    # Steps inside the parts of the sorted places, and from each part to the next one: a row a part.
    here, there = F.struct("b", "least"), F.col("to")
    inside = places.withColumn("to", F.lead(here).over(Window.partitionBy("part").orderBy("b"))).select("b", "least", "to")
    ends = places.groupBy("part").agg(F.max(here).alias("last"), F.min(here).alias("first")).withColumn("to", F.lead("first").over(Window.orderBy("part"))).select("last.*", "to")
    steps = inside.unionByName(ends).filter("to is not null").select(F.col("least").alias("u"), there["least"].alias("v"), F.abs(there["b"] - F.col("b")).alias("w"))
    least = points.agg(F.min("k").alias("u"), F.min(F.when(F.col("b").isNotNull(), F.col("k"))).alias("placed"))
    far = points.filter("b is null").select("k").unionByName(least.select(F.col("placed").alias("k")))
    apart = far.crossJoin(F.broadcast(least.select("u"))).select("u", F.col("k").alias("v"), F.lit(None).cast(dict(steps.dtypes)["w"]).alias("w"))
    every = star.unionByName(steps).unionByName(apart).filter("u <> v")
    return dedupe_edges(every.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w"))
