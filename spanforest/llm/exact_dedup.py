"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts the digests of its texts into a run that holds each
digest once, with the smallest id and the number of rows. Runs are exchanged in
binomial rounds, two at a time: after k exchanges the runs of FAN ** k
partitions have become one, cut by leading digest bits into as many segments;
FAN neighbours hand each other segments, so that a task merges FAN sorted pieces
of about a partition's size whatever the size of the table. After
log_FAN(partitions) exchanges each segment holds its digests of the whole table.
A merge keeps the order of its pieces (a stable sort that finds sorted runs and
merges them) and of equal digests the smallest id. A text's copies collapse in
every run at every level: no round moves more than one row a run for the most
frequent text. Two entries are one only if SHA-256, length in bytes and a
second 64-bit hash of the normalised text agree; that stands for comparing their
bytes, for which every copy's text would have to be moved.

The answers go back to the runs, not to the rows: a run holds each digest once,
so this join has no key with more rows than there are partitions.

Defined results: a null text counts as empty; a null id is larger than any
other; rows with the same id and text are one group like any copies, and only
one of them is kept; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, fresh, ready, written

FAN_BITS = 2
#: Rows of a run that are sorted at once; a longer partition makes several runs.
RUN_ROWS = 1 << 18
#: A run's number is its partition's times this, and its place there.
_FLUSHES = 1 << 32
KEY = 48
ENTRY = "node long, segment long, keys binary, keeps binary"
#: What stands beside a key in a run: the kept row's place, and the rows.
KEEP = np.dtype([("null", "u1"), ("id", "<i8"), ("run", "<i8"), ("rows", "<i8")])


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digest_key(text: Column) -> Column:
    """48 bytes: SHA-256, length and a second hash of the normalised text."""
    return F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")), F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def _merged(keys: np.ndarray, keeps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges sorted runs that stand one after another, in the order of their numbers: (keys, keeps, order)."""
    order = np.argsort(keys, kind="stable")
    keys, keeps = keys[order], keeps[order]
    if not len(keys):
        return keys, keeps, order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    many = np.diff(np.append(first, len(keys)))
    # Of equal keys the smallest id, null the largest; of the same id the first run.
    null, id_ = keeps["null"], np.where(keeps["null"] > 0, 0, keeps["id"])
    some = np.minimum.reduceat(null, first)
    least = np.minimum.reduceat(np.where(null > np.repeat(some, many), np.iinfo(np.int64).max, id_), first)
    good = np.flatnonzero((null == np.repeat(some, many)) & (id_ == np.repeat(least, many)))
    out = keeps[good[np.searchsorted(good, first)]].copy()
    out["rows"] = np.add.reduceat(keeps["rows"], first)
    return keys[first], out, order


def _segments(node: int, segment: int, level: int, keys: np.ndarray, keeps: np.ndarray):
    """The pieces of a run for the next round: cut by the next FAN_BITS bits of the digest."""
    at = level * FAN_BITS
    lead = keys.view(np.uint8).reshape(-1, KEY)[:, at // 8]
    digit = (lead >> np.uint8(8 - FAN_BITS - at % 8)) & np.uint8((1 << FAN_BITS) - 1)
    cut = np.searchsorted(digit, np.arange((1 << FAN_BITS) + 1))  # sorted, as the keys agree before this digit
    for j in range(1 << FAN_BITS):
        a, b = int(cut[j]), int(cut[j + 1])
        if a < b:
            yield node >> FAN_BITS, segment << FAN_BITS | j, keys[a:b].tobytes(), keeps[a:b].tobytes()


def _table(rows) -> pa.Table:
    node, segment, keys, keeps = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"node": pa.array(node, pa.int64()), "segment": pa.array(segment, pa.int64()), "keys": pa.array(keys, pa.binary()), "keeps": pa.array(keeps, pa.binary())})


def _runs(rows: DataFrame) -> DataFrame:
    """Level 0: run, keys, keeps, and all ids of each key (ids, and how many)."""

    def run(batches):
        claim("exact_dedup")
        part, flush, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            number = part * _FLUSHES + flush
            keys, ids, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            keeps = np.zeros(len(keys), KEEP)
            keeps["null"], keeps["id"], keeps["run"], keeps["rows"] = nulls, ids, number, 1
            # Ids in order, so that a key's ids begin with the one that is kept.
            order = np.lexsort((ids, nulls))
            unique, kept, by_key = _merged(keys[order], keeps[order])
            order = order[by_key]
            return pa.record_batch([pa.array([number]), pa.array([unique.tobytes()], pa.binary()), pa.array([kept.tobytes()], pa.binary()), pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([nulls[order].astype(np.uint8).tobytes()], pa.binary())], ["run", "keys", "keeps", "ids", "nulls"])

        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"S{KEY}")
            held.append((keys, ids.fill_null(0).to_numpy(), nulls))
            size += len(keys)
            if size >= RUN_ROWS:
                yield close()
                flush, held, size = flush + 1, [], 0
        if size:
            yield close()

    return rows.mapInArrow(run, "run long, keys binary, keeps binary, ids binary, nulls binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest_key(normalised(F.col(text_col))).alias("key"))
    runs = written(_runs(rows), "digest-runs")
    last = runs.agg(F.max("run")).first()[0]
    parts = 1 if last is None else last // _FLUSHES + 1
    rounds = 1
    while parts > 1 << FAN_BITS * rounds:
        rounds += 1

    def deal(batches):
        claim("exact_dedup")
        for batch in batches:
            for run, keys, keeps in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield from _table(list(_segments(run // _FLUSHES, 0, 0, np.frombuffer(keys, f"S{KEY}"), np.frombuffer(keeps, KEEP)))).to_batches()

    def merge(level: int):
        def run(group: pa.Table) -> pa.Table:
            pieces = sorted(((np.frombuffer(k, KEEP), x) for k, x in zip(group.column("keeps").to_pylist(), group.column("keys").to_pylist(), strict=True)), key=lambda p: int(p[0]["run"].min()))
            keys, keeps, _ = _merged(np.frombuffer(b"".join(x for _, x in pieces), f"S{KEY}"), np.concatenate([k for k, _ in pieces]))
            node, segment = group.column("node")[0].as_py(), group.column("segment")[0].as_py()
            if level < rounds:
                return _table(list(_segments(node, segment, level, keys, keeps)))
            many = keeps["rows"] > 1
            keys, keeps = keys[many], keeps[many]
            cut = np.arange(len(keys) + 1, dtype=np.int32) * KEY
            data = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(cut), pa.py_buffer(keys.tobytes())])
            return pa.table({"key": data, "keep_id": pa.array(keeps["id"].copy(), mask=keeps["null"].astype(bool)), "keep_run": pa.array(keeps["run"].copy()), "group_size": pa.array(keeps["rows"].copy())})

        return run

    pieces = runs.select("run", "keys", "keeps").mapInArrow(deal, ENTRY)
    for level in range(1, rounds):
        pieces = pieces.groupBy("node", "segment").applyInArrow(merge(level), ENTRY)
    roots = pieces.groupBy("node", "segment").applyInArrow(merge(rounds), "key binary, keep_id long, keep_run long, group_size long")

    def unpack(batches):
        claim("exact_dedup")
        for batch in batches:
            for run, keys, keeps, ids, nulls in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows = np.frombuffer(keeps, KEEP)["rows"]
                n, cut = len(rows), np.concatenate([[0], np.cumsum(rows)])
                for at in range(0, n, 1 << 14):
                    to = min(n, at + (1 << 14))
                    own = slice(int(cut[at]), int(cut[to]))
                    flat = pa.array(np.frombuffer(ids, "<i8")[own], mask=np.frombuffer(nulls, np.uint8)[own].astype(bool))
                    data = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(np.arange(to - at + 1, dtype=np.int32) * KEY), pa.py_buffer(keys[at * KEY : to * KEY])])
                    lists = pa.ListArray.from_arrays(pa.array((cut[at : to + 1] - cut[at]).astype(np.int32)), flat)
                    yield pa.record_batch([pa.array(np.full(to - at, run)), data, lists], ["run", "key", "ids"])

    entries = runs.mapInArrow(unpack, "run long, key binary, ids array<long>")
    answered = entries.join(roots, "key", "left").select("key", "run", "keep_run", "keep_id", "group_size", F.posexplode("ids").alias("place", "doc_id"))
    alone = F.col("group_size").isNull()
    first = (F.col("place") == 0) & (F.col("run") == F.col("keep_run")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return answered.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | first).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: one with the group's text and the id named by keep_id, if any of the group has an id.

    Rows are found by id and text, so different texts of one id all stay.
    """
    name, mark, digest = fresh(docs, "_kept_id"), fresh(docs, "_text_sha256"), fresh(docs, "_kept_sha256")
    kept = written(exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(digest)), "kept")
    marked = docs.withColumn(mark, F.sha2(normalised(F.col(text_col)), 256))
    # A null id equals no other in a join and is looked up by its text alone; filters on a null id rarely read anything.
    named = marked.join(kept, (F.col(id_col).cast("long") == F.col(name)) & (F.col(mark) == F.col(digest)), "left_semi").dropDuplicates([id_col, mark])
    digests = kept.filter(F.col(name).isNull()).select(digest)
    unnamed = marked.filter(F.col(id_col).isNull()).join(digests, F.col(mark) == F.col(digest), "left_semi").dropDuplicates([mark])
    return named.unionByName(unnamed).drop(mark)
