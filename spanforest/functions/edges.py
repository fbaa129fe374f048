"""Column expressions over edges, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """The words of a line of an edge list."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def token(line: Column, place: int, kind: str) -> Column:
    """The word at a place (from 1) as a number, null if it is none or isn't there."""
    return F.try_element_at(tokens(line), F.lit(place)).try_cast(kind)


def rebased(vertex: Column, offset: int) -> Column:
    return vertex - F.lit(offset)


def uniform(low: float, high: float, seed: int) -> Column:
    """A random number in [low, high)."""
    return F.lit(float(low)) + F.rand(seed) * F.lit(float(high) - float(low))


def jittered(weight: Column, seed: int, by: float = 1.0) -> Column:
    """The weight moved by a random amount in [-by, by)."""
    return weight + uniform(-by, by, seed)


def edge_line(u: Column, v: Column, w: Column) -> Column:
    """`u v w`, as edge lists are written."""
    return F.concat_ws(" ", u.cast("string"), v.cast("string"), w.cast("string"))


def edge_text(u: Column, v: Column, w: Column) -> Column:
    return F.format_string("Edge from: %s to: %s weight: %s", u.cast("string"), v.cast("string"), w.cast("string"))


def label_text(vertex: Column, component: Column) -> Column:
    return F.format_string("%s: component=%s", vertex.cast("string"), component.cast("string"))


def vertex_text(vertex: Column) -> Column:
    return F.format_string("Node %s", vertex.cast("string"))
