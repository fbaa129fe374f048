"""Edge lists as text or Parquet, and random graphs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.edges import edge_line, rebased, token, uniform
from ..operators.prepare import prepare_edges, vertices_of
from ..operators.state import written


class EdgeList(NamedTuple):
    edges: DataFrame  # u, v, w as they stand in the file, and `line`, their order
    rejects: DataFrame  # lines that hold no edge


def read_edges(spark: SparkSession, path: str, *, weighted: bool = True, id_offset: int = 0, comment: str = "#%", weights: tuple[float, float] = (0.0, 10.0), seed: int = 0) -> EdgeList:
    """Reads lines `u v w`, or `u v` with random weights, split by white space.

    Blank lines and lines that begin with a character of `comment` are skipped;
    a line with a missing or unreadable number goes to `rejects` and nothing
    stops there. Further words of a line are ignored. `id_offset` is taken from
    both ids. `line` grows in the order of files, blocks and lines.
    """
    text = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"))
    said = text.filter((F.trim("value") != "") & ~F.substring(F.trim("value"), 1, 1).isin(*(list(comment) or [""])))
    line = F.col("value")
    weight = token(line, 3, "double") if weighted else uniform(*weights, seed)
    read = said.select("value", "line", rebased(token(line, 1, "bigint"), id_offset).alias("u"), rebased(token(line, 2, "bigint"), id_offset).alias("v"), weight.alias("w"))
    whole = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("w").isNotNull() & ~F.isnan("w")
    return EdgeList(read.filter(whole).select("u", "v", "w", "line"), read.filter(~whole).select("value"))


def write_edges(edges: DataFrame, path: str, form: str = "text") -> None:
    """Writes u, v, w as lines `u v w`, or as a Parquet table."""
    if form == "text":
        edges.select(edge_line(F.col("u"), F.col("v"), F.col("w"))).write.text(path)
    elif form == "parquet":
        edges.select("u", "v", "w").write.parquet(path)
    else:
        raise ValueError(f"form is 'text' or 'parquet', not {form!r}")


def generate_graph(spark: SparkSession, n: int, m: int, *, low: float = 1.0, high: float = 10.0, seed: int = 0) -> DataFrame:
    """A simple random graph: `m` different undirected edges among ids 0 to n - 1, weights in [low, high).

    Pairs are drawn in lots until enough are distinct; the draw is written, so
    the graph doesn't change when it is read twice.
    """
    most = n * (n - 1) // 2
    if n < 0 or m < 0 or m > most:
        raise ValueError(f"{n} vertices have at most {most} edges, not {m}")
    schema = "u bigint, v bigint"
    if m > most // 2:
        # Dense: all pairs in random order, by their number.
        number = F.col("id")
        v = F.floor((1 + F.sqrt(1 + 8 * number.cast("double"))) / 2).cast("bigint")
        v = F.when(v * (v - 1) / 2 > number, v - 1).when((v + 1) * v / 2 <= number, v + 1).otherwise(v)
        pairs = spark.range(most).select(v.alias("v"), number).select((F.col("id") - F.floor(F.col("v") * (F.col("v") - 1) / 2)).cast("bigint").alias("u"), "v")
        pairs = first_rows(pairs, F.rand(seed), m)
    else:
        pairs, have, lot = spark.createDataFrame([], schema), 0, 0
        while have < m:
            draw = spark.range(int((m - have) * 1.3) + 16)
            x, y = (F.floor(F.rand(seed + 2 * lot + k) * n).cast("bigint") for k in (0, 1))
            drawn = draw.select(x.alias("x"), y.alias("y")).filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
            pairs = written(pairs.unionByName(drawn).distinct(), "pairs")
            have, lot = pairs.count(), lot + 1
        pairs = first_rows(pairs, F.xxhash64("u", "v", F.lit(seed)), m) if have > m else pairs
    return written(pairs.withColumn("w", uniform(low, high, seed + 1_000_003)), "graph")


def first_rows(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the smallest keys, at any n: a sort by ranges, of which
    the driver learns one count a partition, not a limit that ends in one task."""
    placed = written(df.withColumn("_key", key).orderBy("_key").withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", 33)
    left, end = n, 0
    for part_, size in sorted(map(tuple, placed.groupBy(part).count().collect())):
        end = (part_ << 33) + min(left, size)
        left -= min(left, size)
        if not left:
            break
    return placed.filter(F.col("_place") < end).drop("_key", "_place")


def load_graph(spark: SparkSession, path: str = "", *, n: int = 0, m: int = 0, **how) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices): of a file if one is named, else of a random graph."""
    edges = prepare_edges(read_edges(spark, path, **how).edges, order_col="line") if path else generate_graph(spark, n, m, **how)
    return edges, vertices_of(edges)
