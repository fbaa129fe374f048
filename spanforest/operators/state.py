"""Tables that end lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a
    temporary one is set only where none is, as in tests in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = Path(tempfile.mkdtemp(prefix="checkpoint-")).as_uri()
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders made since the innermost `swept` of this thread began; what other threads make is theirs.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_folder(spark: SparkSession, what: str) -> str:
    """The URI of a new folder in the shared one."""
    folder = shared_folder(spark)
    if ":" not in folder.split("/")[0]:
        folder = Path(folder).absolute().as_uri()
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def gathered(df: DataFrame) -> DataFrame:
    """Small rows, dealt evenly to a few partitions where Spark doesn't join small
    ones itself. Each would be a file else, for which Hadoop's local file system
    starts three processes out of the executor's."""
    spark = df.sparkSession
    on = [spark.conf.get(f"spark.sql.adaptive.{x}", "true").lower() for x in ("enabled", "coalescePartitions.enabled")]
    few = 2 * spark.sparkContext.defaultParallelism
    return df if on == ["true", "true"] or int(spark.conf.get("spark.sql.shuffle.partitions")) <= few else df.repartition(few)


def written(df: DataFrame, what: str, *, small: bool = False) -> DataFrame:
    """The rows, written once to the shared folder and read from there: a lost
    executor costs a reread, and plans don't grow with the rounds. `small`: rows of
    a few numbers, which are gathered first."""
    spark = df.sparkSession
    df = gathered(df) if small else df
    path = new_folder(spark, what)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads, so that rounds don't pile up on disk."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if (made := _made.get()) and path in made:
        made.remove(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what was written inside by this thread, but for the tables in the list it gives."""
    kept: list[DataFrame] = []
    outer, own = _made.get(), []
    token = _made.set(own)
    try:
        yield kept
    finally:
        _made.reset(token)
        stay = {getattr(t, "_written_to", None) for t in kept}
        for path in own:
            if path not in stay:
                delete(spark, path)
            elif outer is not None:
                outer.append(path)
