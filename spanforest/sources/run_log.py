"""Logs of timed runs as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The forms of a log's lines. The colon after `time` is there only without workers.
READ = r"^\s*([^;]*?)\s*;\s*read time:\s*(\d+)\s*usec;?\s*$"
RUN = r"^\s*(?:workers:\s*(\d+)|([^;:]*?))\s*;\s*iters:\s*(\d+)\s*;\s*time:?\s*(\d+)\s*usec;?\s*$"


def run_log_lines(runs: DataFrame) -> DataFrame:
    """A line of text for each run (engine, workers, iters, usec); workers null: a sequential run."""
    alone = F.format_string("%s; iters: %d; time: %d usec", "engine", "iters", "usec")
    pool = F.format_string("workers: %d; iters: %d; time %d usec", "workers", "iters", "usec")
    return runs.select("engine", F.when(F.col("workers").isNull(), alone).otherwise(pool).alias("line"))


def parse_run_log(lines: DataFrame) -> DataFrame:
    """engine, workers, iters, usec of the run lines of (engine, line); a sequential run has one worker.

    Lines of other forms, headers among them, are left out.
    """
    take = lambda k: F.regexp_extract("line", RUN, k)
    read = lines.filter(F.col("line").rlike(RUN))
    return read.select("engine", F.when(take(1) != "", take(1).try_cast("int")).otherwise(F.lit(1)).alias("workers"), take(3).try_cast("int").alias("iters"), take(4).try_cast("bigint").alias("usec"))


def parse_read_times(lines: DataFrame) -> DataFrame:
    """engine (as the header names it) and usec of the header lines."""
    return lines.filter(F.col("line").rlike(READ)).select(F.regexp_extract("line", READ, 1).alias("engine"), F.regexp_extract("line", READ, 2).cast("bigint").alias("usec"))


def read_run_logs(spark, paths: dict[str, str]) -> DataFrame:
    """(engine, line) of the log files of each engine."""
    out = None
    for engine, path in paths.items():
        lines = spark.read.text(path).select(F.lit(engine).alias("engine"), F.col("value").alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out
