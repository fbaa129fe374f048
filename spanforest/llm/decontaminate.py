"""Benchmark decontamination: word windows of the test items, looked up in all texts.

The windows of the items are hashed, sorted and broadcast; each task hashes the
windows of its texts, looks them up, compares the words of every hit byte by
byte, and marks the words that a true hit covers. No row is shuffled.

A broadcast holds a block of items of at most `block_bytes` of text (a longer
item goes alone), whose size is measured first; a larger benchmark is
dealt to several blocks, of which a task has one in memory at a time.

Defined results: a null text has no words; an item without words has no
window and is never found; a null item id is written as an empty string; items
are told apart by id, so rows with the same id count once; empty tables give no
rows or rows without hits; columns other than those named are not read, and
removal passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES as LOOK_BYTES
from .common import binary, blocks, claim, ready
from .words import LOWER, Words, windows, words

WINDOW = 10
BLOCK_BYTES = 8 << 20


class Items(NamedTuple):
    """Windows of one length, sorted by hash; text[start:end] are a window's words, lower-cased, one space between."""

    size: int
    hashes: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray
    maybe: np.ndarray  # by leading hash bits: whether any window has them


class Block(NamedTuple):
    names: list[str]
    text: bytes
    tables: list[Items]


def block_of(names: list[str], texts: list[str], window: int) -> Block:
    offsets, data = binary(pa.array(texts, pa.large_string()))
    w = words(offsets, data)
    many = np.diff(w.first)
    # The words of all items with one space after each.
    size = w.end - w.start + 1
    at = np.cumsum(size) - size
    low = LOWER[data].tobytes()
    text = b"".join(low[a:b] + b" " for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))
    tables = []
    for length in sorted({window, *many[(many > 0) & (many < window)].tolist()}):
        first, hashes = windows(w, length)
        if length < window:
            own = many[w.doc[first]] == length
            first, hashes = first[own], hashes[own]
        if not len(first):
            continue
        order = np.argsort(hashes, kind="stable")
        first, hashes = first[order], hashes[order]
        maybe = np.zeros(1 << 20, bool)
        maybe[hashes >> np.uint64(44)] = True
        last = first + length - 1
        tables.append(Items(length, hashes, w.doc[first], at[first], at[last] + size[last] - 1, maybe))
    return Block(names, text, tables)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Block]:
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    many = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(many):
        own = rows if many == 1 else rows.filter(F.pmod(F.xxhash64("name", "text"), F.lit(many)) == k)
        got = own.collect()
        at = 0
        while at < len(got):  # hashing deals only about evenly
            to, size = at, 0
            while to < len(got) and (to == at or size + len(got[to].text.encode()) <= block_bytes):
                size += len(got[to].text.encode())
                to += 1
            yield block_of([r.name for r in got[at:to]], [r.text for r in got[at:to]], window)
            at = to


class Hits(NamedTuple):
    words: Words
    covered: np.ndarray  # of each word
    rows: np.ndarray  # of each verified (row, item), distinct
    items: np.ndarray


def look_up(block: Block, offsets: np.ndarray, data: np.ndarray, w: Words | None = None) -> Hits:
    w = w or words(offsets, data)
    depth = np.zeros(len(w.hash) + 1, np.int64)
    rows: list[int] = []
    items: list[int] = []
    for t in block.tables:
        first, hashes = windows(w, t.size)
        maybe = np.flatnonzero(t.maybe[hashes >> np.uint64(44)])
        left = np.searchsorted(t.hashes, hashes[maybe], "left")
        right = np.searchsorted(t.hashes, hashes[maybe], "right")
        found = np.flatnonzero(left < right)
        for i, a, b in zip(first[maybe[found]].tolist(), left[found].tolist(), right[found].tolist(), strict=True):
            low = LOWER[data[w.start[i] : w.end[i + t.size - 1]]].tobytes()
            base = int(w.start[i])
            own = b" ".join(low[s - base : e - base] for s, e in zip(w.start[i : i + t.size].tolist(), w.end[i : i + t.size].tolist(), strict=True))
            true = [j for j in range(a, b) if block.text[t.start[j] : t.end[j]] == own]
            if true:
                depth[i] += 1
                depth[i + t.size] -= 1
                row = int(w.doc[i])
                rows += [row] * len(true)
                items += [int(t.item[j]) for j in true]
    both = np.unique(np.stack([np.array(rows, np.int64), np.array(items, np.int64)], 1), axis=0)
    return Hits(w, np.cumsum(depth[:-1]) > 0, both[:, 0], both[:, 1])


def _each(broadcasts: list[Broadcast]) -> Iterator[Block]:
    for b in broadcasts:
        yield Block(*b.value)
        if len(broadcasts) > 1:  # one block in memory at a time; the file of the broadcast stays
            b.__dict__.pop("_value", None)


def _reach(broadcasts: list[Broadcast]) -> int:
    """Bytes of text to look at in one go: more where there are more blocks, each of which is loaded again for them."""
    return LOOK_BYTES * min(8, max(1, len(broadcasts)))


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> list[Broadcast]:
    spark = docs.sparkSession
    ready(spark)
    return [spark.sparkContext.broadcast(tuple(b)) for b in item_blocks(benchmark, item_col, item_text_col, window, block_bytes)]


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (begin and end byte of covered words) of each row."""
    held = _blocks(docs, benchmark, item_col, item_text_col, window, block_bytes)

    def run(batches):
        claim("decontaminate")
        for batch in batches:
            whole, bytes_ = binary(batch.column(1))
            for at, to in blocks(whole, _reach(held)):
                offsets, data = whole[at : to + 1] - whole[at], bytes_[whole[at] : whole[to]]
                w = words(offsets, data)
                covered = np.zeros(len(w.hash), bool)
                names: list[set[str]] = [set() for _ in range(to - at)]
                for block in _each(held):
                    hits = look_up(block, offsets, data, w)
                    covered |= hits.covered
                    for r, i in zip(hits.rows.tolist(), hits.items.tolist(), strict=True):
                        names[r].add(block.names[i])
                total = np.concatenate([[0], np.cumsum(covered)])
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                items = [sorted(x) for x in names]
                spans = [_spans(w, covered, r, int(offsets[r])) if names[r] else [] for r in range(to - at)]
                yield pa.record_batch(
                    [batch.column(0).slice(at, to - at), pa.array(np.diff(w.first)), pa.array(n_hit), pa.array(list(map(len, items)), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array(n_hit > 0), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<begin: long, end: long>>")


def _spans(w: Words, covered: np.ndarray, row: int, base: int) -> list[dict[str, int]]:
    a, b = int(w.first[row]), int(w.first[row + 1])
    mark = np.concatenate([[False], covered[a:b], [False]])
    edge = np.flatnonzero(mark[1:] != mark[:-1])
    return [{"begin": int(w.start[a + s]) - base, "end": int(w.end[a + e - 1]) - base} for s, e in zip(edge[::2], edge[1::2], strict=True)]


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, what: str = "documents", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns as they were, without contaminated ones, or (what="spans") without the covered words in their texts."""
    if what not in ("documents", "spans"):
        raise ValueError(f"what is 'documents' or 'spans', not {what!r}")
    held = _blocks(docs, benchmark, item_col, item_text_col, window, block_bytes)
    place = docs.columns.index(text_col)

    def run(batches):
        claim("decontaminate")
        for batch in batches:
            whole, bytes_ = binary(batch.column(place))
            for at, to in blocks(whole, _reach(held)):
                offsets, data = whole[at : to + 1] - whole[at], bytes_[whole[at] : whole[to]]
                w = words(offsets, data)
                covered = np.zeros(len(w.hash), bool)
                for block in _each(held):
                    covered |= look_up(block, offsets, data, w).covered
                total = np.concatenate([[0], np.cumsum(covered)])
                hit = total[w.first[1:]] > total[w.first[:-1]]
                part = batch.slice(at, to - at)
                if what == "documents":
                    yield part.filter(pa.array(~hit))
                elif not hit.any():
                    yield part
                else:
                    texts = part.column(place).to_pylist()
                    for r in np.flatnonzero(hit).tolist():
                        own, pieces, end = data[offsets[r] : offsets[r + 1]].tobytes(), [], 0
                        for span in _spans(w, covered, r, int(offsets[r])):
                            pieces.append(own[end : span["begin"]])
                            end = span["end"]
                        texts[r] = b"".join([*pieces, own[end:]]).decode()
                    yield part.set_column(place, part.schema.field(place), pa.array(texts, part.column(place).type))

    return docs.mapInArrow(run, docs.schema)
