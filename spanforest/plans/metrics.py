"""Tables about timed runs (engine, workers, iters, usec)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_times(runs: DataFrame) -> DataFrame:
    """engine, workers, n, mean_usec, std_usec (sample deviation)."""
    return runs.groupBy("engine", "workers").agg(F.count("*").alias("n"), (F.sum("usec") / F.count("*")).alias("mean_usec"), F.stddev_samp("usec").alias("std_usec"))


def scaling_report(runs: DataFrame, baseline: str) -> DataFrame:
    """engine, workers, mean_usec, speedup (baseline's mean over own), scalability (mean with the fewest workers over own), efficiency (speedup a worker).

    A row for each engine but the baseline and each number of workers.
    """
    means = mean_times(runs)
    base = runs.filter(F.col("engine") == baseline).agg((F.sum("usec") / F.count("*")).alias("base_usec"))
    line = Window.partitionBy("engine").orderBy("workers").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A row for each engine and number of workers, and one row beside them.
    return (
        means.filter(F.col("engine") != baseline)
        .withColumn("scalability", F.first("mean_usec").over(line) / F.col("mean_usec"))
        .crossJoin(base)
        .withColumn("speedup", F.col("base_usec") / F.col("mean_usec"))
        .select("engine", "workers", "mean_usec", "speedup", "scalability", (F.col("speedup") / F.col("workers")).alias("efficiency"))
    )
