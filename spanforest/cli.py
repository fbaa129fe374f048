"""`python -m spanforest.cli`: times minimum spanning forests of a file or a random graph."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.forest import forest_weight, minimum_spanning_forest
from .operators.prepare import graph_counts
from .operators.state import swept, written
from .sources.edge_list import load_graph
from .sources.run_log import run_log_lines


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanforest", description=__doc__)
    parser.add_argument("file", nargs="?", default="", help="an edge list; without one a random graph is made")
    parser.add_argument("--nodes", type=int, default=1000)
    parser.add_argument("--edges", type=int, default=5000, help="undirected edges of the random graph")
    parser.add_argument("--unweighted", action="store_true", help="lines hold two ids; weights are random")
    parser.add_argument("--id-offset", type=int, default=0)
    parser.add_argument("--iters", type=int, default=1, help="timed repetitions")
    parser.add_argument("--workers", default="0", help="local threads (0: as the session has them), or several counts with commas between: a session for each, in turn")
    parser.add_argument("--log", default="", help="file that the lines of all runs are added to, as `scaling_report` reads them")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--out", default="", help="folder for the forest, as Parquet")
    args = parser.parse_args(arguments)
    try:
        counts = [int(k) for k in args.workers.split(",")]
    except ValueError:
        parser.error(f"--workers takes whole numbers, not {args.workers!r}")
    said: list[str] = []
    for k in counts:
        builder = SparkSession.builder.appName("spanforest")
        if k and len(counts) > 1 and (running := SparkSession.getActiveSession()):
            running.stop()  # a running session would keep its own number of threads
        said += timed(args, k, (builder.master(f"local[{k}]") if k else builder).getOrCreate())
    if args.log:
        with open(args.log, "a") as log:
            log.writelines(f"{line}\n" for line in said)
    return 0


def timed(args: argparse.Namespace, workers: int, spark: SparkSession) -> list[str]:
    """Runs and prints what was asked for with one number of workers; the lines of the log."""
    began = time.perf_counter_ns()
    how = {"weighted": not args.unweighted, "id_offset": args.id_offset} if args.file else {"n": args.nodes, "m": args.edges}
    edges, vertices = load_graph(spark, args.file, seed=args.seed, **how)
    edges = written(edges, "graph")
    counts = graph_counts(edges).first()
    said = [f"spark; read time: {(time.perf_counter_ns() - began) // 1000} usec"]
    print(said[0])
    print(f"vertices: {counts.vertices}; edges: {counts.edges}")
    runs = []
    for _ in range(max(1, args.iters)):
        began, stages = time.perf_counter_ns(), []
        with swept(spark) as kept:
            result = minimum_spanning_forest(edges, vertices)
            stages.append(("rounds", time.perf_counter_ns()))
            forest = written(result.edges, "forest")
            stages.append(("forest", time.perf_counter_ns()))
            weight = forest_weight(forest).first()
            rounds = result.trace.agg(F.max("round")).first()[0] or 0
            stages.append(("weight and trace", time.perf_counter_ns()))
            kept.append(forest)
        runs.append(("spark", workers or None, rounds, (stages[-1][1] - began) // 1000))
        for (name, end), start in zip(stages, [began, *(t for _, t in stages)], strict=False):
            print(f"stage {name}: {(end - start) // 1000} usec")
    for row in run_log_lines(spark.createDataFrame(runs, "engine string, workers int, iters int, usec long")).collect():
        said.append(row.line)
        print(row.line)
    print(f"forest edges: {weight.edges}; weight: {weight.weight}")
    if args.out:
        forest.write.mode("overwrite").parquet(args.out)
    return said


if __name__ == "__main__":
    sys.exit(main())
