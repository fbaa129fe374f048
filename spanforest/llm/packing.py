"""Packing by concatenation and cutting.

All documents' tokens stand in one line, in partition order; sequences are
fixed windows of that line. Two passes give each document its place: the first
tokenises and writes ids with each document's start inside its partition, then
a prefix sum over the partitions' totals (one row a partition) gives each
partition's start, and the second pass cuts every document at the windows'
borders. A piece that crosses none is a whole document; the others carry
boundary marks.

Defined results: a null or empty text has the end id alone; a null id stays
null; repeated rows are packed as often as they stand there; an empty table
gives no piece; columns other than the id and the text are not read. Memory is
bounded by an Arrow batch: no task holds a partition's tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, blocks, claim, ready, written
from .tokens import CACHE_PIECES, TEXT_BYTES, loaded, vocabulary

TOKENS = "part long, doc_id {id}, start_in_part long, n_tokens long, ids binary"
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, opens boolean, closes boolean, ids binary"


def tokenised(docs: DataFrame, id_col: str, text_col: str, vocab: str, end_id: int, cache_pieces: int = CACHE_PIECES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Ids (little-endian, 32 bits) of each row, with its partition and its start in it."""

    def run(batches):
        claim("tokens")
        part, total = TaskContext.get().partitionId(), 0
        tokenizer = loaded(vocabulary(vocab), cache_pieces)
        for batch in batches:
            offsets, _ = binary(batch.column(1))
            for at, to in blocks(offsets, text_bytes):
                whole, counts = tokenizer.encode_column(batch.column(1).slice(at, to - at), end_id)
                cut = np.concatenate([[0], np.cumsum(counts)])
                data = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(whole.astype("<u4"))])
                yield pa.record_batch([pa.array(np.full(to - at, part)), batch.column(0).slice(at, to - at), pa.array(total + cut[:-1]), pa.array(counts), data], ["part", "doc_id", "start_in_part", "n_tokens", "ids"])
                total += int(cut[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    ready(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, TOKENS.format(id=kind))


def pieces_of(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first token in the row, tokens) of each piece of rows at the given starts of the line."""
    first, last = starts // length, (starts + counts - 1) // length
    many = last - first + 1
    row = np.repeat(np.arange(len(starts)), many)
    window = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[row]
    begin = np.maximum(window * length, starts[row]) - starts[row]
    end = np.minimum((window + 1) * length, starts[row] + counts[row]) - starts[row]
    return row, begin, end - begin


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str = "byte_bpe_50k.json", length: int = 1024, end_id: int = 0, cache_pieces: int = CACHE_PIECES, text_bytes: int = TEXT_BYTES, with_ids: bool = True) -> DataFrame:
    """The pieces of all sequences, with their ids (`with_ids`) or the ids' checksums alone.

    `opens` and `closes` say whether the piece holds its document's first and
    last token; a document with a piece that lacks one was cut at a border.
    Every sequence but the last has exactly `length` tokens.
    """
    tokens = written(tokenised(docs, id_col, text_col, vocab, end_id, cache_pieces, text_bytes), "tokens")
    # A row for each partition of the input: the window's one task and the broadcast hold no more.
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(line), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")

    def run(batches):
        claim("tokens")
        for batch in batches:
            offsets, data = binary(batch.column(3))
            starts, counts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            row, begin, size = pieces_of(starts, counts, length)
            if not len(row):
                continue
            at = offsets[row] + 4 * begin
            to = at + 4 * size
            view = memoryview(data)
            crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), to.tolist(), strict=True)), np.int64, len(row))
            # The pieces of a batch are its ids, cut: their bytes stand in the same order.
            cut = np.concatenate([at, to[-1:]])
            if not with_ids:
                cut, data = cut * 0, data[:0]
            place = starts[row] + begin
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row)), *map(pa.array, (begin, size, crc, counts[row], place // length, place % length, begin == 0, begin + size == counts[row])), pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "opens", "closes", "ids"],
            )

    pieces = placed.mapInArrow(run, PIECES.format(id=tokens.schema["doc_id"].dataType.simpleString()))
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame, *, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array, n_tokens): each sequence, padded to `length`. A group has `length` pieces at most."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<u4").astype(np.int64)
        whole = np.full(length, pad_id, np.int64)
        whole[: len(ids)] = ids
        return pa.table({"sequence_id": group.column("sequence_id").slice(0, 1), "ids": pa.array([whole.tolist()], pa.list_(pa.int64())), "n_tokens": pa.array([len(ids)], pa.int64())})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<long>, n_tokens long")
