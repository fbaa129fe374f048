"""What the operators of this subpackage share: shared folders, shipping of the
code to executors, and walking over Arrow batches in pieces of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.state import new_folder as shared_dir
from ..operators.state import swept, written

__all__ = ["shared_dir", "swept", "written"]

#: Bytes of text that a vectorised kernel looks at in one go; one longer text goes alone.
BLOCK_BYTES = 1 << 20
#: Bytes in one Arrow batch between the JVM and Python, where the session sets nothing else.
BATCH_BYTES = 8 << 20
#: Rows in one, where the session has Spark's default of 10,000.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """The name, or one like it, that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ready(spark: SparkSession) -> None:
    """Lets executors import this package, and bounds Arrow batches where the session doesn't."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "", str(2**31 - 1), "2147483647b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_spanforest_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(to))
    context._spanforest_shipped = True


#: Called when a Python worker turns from one operator to another: what the last one cached goes.
CLEARED: list[Callable[[], None]] = []
_claimed = ""


def claim(operator: str) -> None:
    """Said by an operator's task when it begins. Workers are used again by other
    operators' tasks, whose memory must not add up to that of all of them."""
    global _claimed
    if _claimed not in ("", operator):
        for clear in CLEARED:
            clear()
        give_back()
        trim()
    _claimed = operator


def give_back() -> None:
    """From now on freed arrays leave this process at once. By default glibc and Arrow
    keep tens of MB, more after each larger array; that is faster, and is left to
    workers that run one operator only."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which moves no more once it is set


def trim() -> None:
    """Gives freed memory back, which glibc keeps otherwise."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of a string or binary column, null as empty; no copy of the bytes."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], bytes_[o[0] : o[-1]]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes are at most `most`, or of one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to



def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over an array of unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def filesystem(uri: str):
    """(file system, path) for file:, hdfs:, s3: and the other schemes that Arrow opens."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes | list[bytes]) -> None:
    """Writes a file so that it appears whole or not at all: a task that is run
    again writes its own temporary file and renames it over the same name."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for piece in [data] if isinstance(data, bytes) else data:
            out.write(piece)
    store.move(part, path)


def get(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return f.read()
