"""A spanning forest kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.forest import minimum_spanning_forest
from ..operators.prepare import dedupe_edges, prepare_edges
from ..operators.state import delete, swept


def maintain_forest(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the minimum spanning forest of all edges (u, v, w) so far, a Parquet folder for each of the last two batches.

    The forest of a union is the forest of the union of forests, so a batch
    needs only the forest before it: state is one edge a vertex at most,
    whatever has streamed by. A batch that runs again overwrites its own folder.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = prepare_edges(batch)
        if number > 0:
            fresh = dedupe_edges(fresh.unionByName(spark.read.parquet(f"{folder}/batch={number - 1}").select("u", "v", "w")))
        with swept(spark):
            minimum_spanning_forest(fresh).edges.select("u", "v", "w").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if number > 1:  # the batch before the last is what a batch that runs again reads
            delete(spark, f"{folder}/batch={number - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
