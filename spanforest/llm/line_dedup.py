"""Repeated runs of lines across documents.

`drop_repeats`: a line goes if it lies in a repeat: a run of two or more lines,
not white space alone, or one line of more than LONG_WORDS words, that stands
byte for byte at an earlier place (smaller document id, then nearer to the
beginning). Every pair of neighbouring lines is a candidate start, so runs are
found whatever stands around them, and however short they are: candidates that
continue each other in both places are put together to the whole repeat, whose
bytes are fetched from the earlier place and compared where they are cut. Each
line that goes has an equal one that stays at an earlier place.

Texts are shuffled twice, whatever the repetition: once to fetch the bytes of
earlier places, once to cut. Candidates are grouped by hash with partial sums
and joined, so a run that a third of all documents share is split by Spark's
skew handling and no task collects it.

`drop_repeated`: the coarser rule by content-defined chunks. A rolling hash over
the last lines' hashes says after which line a chunk ends, and only whole chunks
are compared, so it misses most repeats of a few lines. Single lines stay.

Defined results: a null text stays null, has no lines, and is never cut; an
empty text has one empty line; a single line of at most LONG_WORDS words stays
however often it occurs, unless in a repeat with a neighbour; words are runs of
bytes above the blank; of lines of white space alone in a row, those with no
line with text beside them go only in a repeat that holds the lines with text
on both sides; runs of white space alone are not removed; a null id comes last
in the order, and its rows are told apart by their content alone, so they are
not cut; rows with the same id and text are one document and are cut alike; of
rows with the same id and different texts a place is cut where its bytes are
the removed ones; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, blocks, claim, ready, splitmix, swept, written
from .words import powers_to

#: Lines that the rolling hash looks back on, and one in how many lines ends a chunk.
LOOK_BACK, ONE_IN = 2, 2
LEAST_LINES, MOST_LINES = 2, 64
#: Words that a single line must exceed to be a repeat by itself.
LONG_WORDS = 50

_VALUES = splitmix(np.arange(256, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(9)) | np.uint64(1)


def lines_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first line of each row and one more): lines of each row, without their line feeds."""
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, feeds, "right") - 1
    many = np.bincount(row, minlength=len(offsets) - 1) + 1
    first = np.concatenate([[0], np.cumsum(many)])
    end = np.empty(first[-1], np.int64)
    last = first[1:] - 1
    inner = np.ones(len(end), bool)
    inner[last] = False
    end[last], end[inner] = offsets[1:], feeds
    begin = np.empty(len(end), np.int64)
    begin[first[:-1]] = offsets[:-1]
    inner = np.ones(len(end), bool)
    inner[first[:-1]] = False
    begin[inner] = feeds + 1
    return begin, end, first


def hashes_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return splitmix((total[end] - total[begin]) * down[np.minimum(begin, len(data))] + (end - begin).astype(np.uint64))


def chunks_of(line: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of each chunk, by the lines' hashes."""
    rolling = np.zeros(len(line), np.uint64)
    back = line.copy()
    for k in range(LOOK_BACK):
        rolling = rolling * np.uint64(0xD6E8FEB86659FD93) + back
        back = np.concatenate([np.zeros(1, np.uint64), back[:-1]])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.arange(len(line)) - first[row] >= LOOK_BACK - 1
    ends = whole & (splitmix(rolling) % np.uint64(ONE_IN) == 0)
    ends[first[1:] - 1] = True
    starts, stops = [], []
    at = 0
    closing = set((first[1:]).tolist())
    for stop in (np.flatnonzero(ends) + 1).tolist():
        if stop - at < LEAST_LINES and stop not in closing:
            continue
        while stop - at > MOST_LINES:
            starts.append(at)
            at += MOST_LINES
            stops.append(at)
        starts.append(at)
        stops.append(stop)
        at = stop
    return np.array(starts, np.int64), np.array(stops, np.int64)


def chunk_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, begin, size, hash of each chunk of several lines that is not white space alone; begin and size in bytes."""

    def run(batches):
        claim("line_dedup")
        for batch in batches:
            whole, bytes_ = binary(batch.column(1))
            for at, to in blocks(whole):
                data = bytes_[whole[at] : whole[to]]
                offsets = whole[at : to + 1] - whole[at]
                begin, end, first = lines_of(offsets, data)
                start, stop = chunks_of(hashes_of(data, begin, end), first)
                black = np.concatenate([[0], np.cumsum(data > 32)])
                a, b = begin[start], end[stop - 1]
                good = (stop - start >= LEAST_LINES) & (black[b] > black[a])
                start, stop, a, b = start[good], stop[good], a[good], b[good]
                row = np.searchsorted(first, start, "right") - 1
                yield pa.record_batch([batch.column(0).take(pa.array(at + row)), pa.array(a - offsets[row]), pa.array(b - a), pa.array(hashes_of(data, a, b).view(np.int64))], ["doc_id", "begin", "size", "hash"])

    return docs.select(F.col(id_col).cast("long"), text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).mapInArrow(run, "doc_id long, begin long, size long, hash long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, size, bytes of each chunk to remove: equal bytes stand earlier in the order."""
    chunks = written(chunk_table(docs, id_col, text_col).distinct(), "chunks")
    # Sums are written before rows are joined with them: Spark splits a skewed join only where both sides come straight from a shuffle.
    often = written(chunks.groupBy("hash", "size").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated-hashes")
    wanted = chunks.join(often, ["hash", "size"], "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("begin", "size", "hash")).alias("places"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")

    def run(batches):
        claim("line_dedup")
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("size", pa.int64()), ("hash", pa.int64()), ("bytes", pa.binary())]))
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out.append([p | {"bytes": text[p["begin"] : p["begin"] + p["size"]]} for p in places])
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], ["doc_id", "places"])

    fetched = texts.join(wanted, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "doc_id long, places array<struct<begin: long, size: long, hash: long, bytes: binary>>")
    # A place in a row of the same id but another text has other bytes, of any size: it is no candidate.
    held = written(fetched.select("doc_id", F.inline("places")).filter(F.octet_length("bytes") == F.col("size")), "candidates")
    first = written(held.groupBy("hash", "size").agg(F.min(F.struct("doc_id", "begin", "bytes")).alias("first")), "first-chunks")
    twice = held.join(first, ["hash", "size"]).filter("bytes = first.bytes and (doc_id <> first.doc_id or begin <> first.begin)")
    return twice.select("doc_id", "begin", "size", F.col("bytes")).distinct()


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_lines, n_chunks_removed, n_lines_removed of each row, `text` without repeated chunks."""
    ready(docs.sparkSession)
    gone = written(repeated(docs, id_col, text_col).select("doc_id", "begin", "size", F.crc32("bytes").alias("check")), "repeated")
    cuts = gone.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "size", "check"))).alias("cuts"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(cuts, "doc_id", "left").select("doc_id", "text", "cuts")

    def run(batches):
        claim("line_dedup")
        for batch in batches:
            whole, _ = binary(batch.column(1))
            for at, to in blocks(whole):
                part = batch.slice(at, to - at)
                texts, lines, chunks, removed = [], [], [], []
                for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lines.append(0 if text is None else text.count(b"\n") + 1)
                    pieces, end, n, gone_lines = [], 0, 0, 0
                    for c in cuts or [] if text is not None else []:
                        a, b = c["begin"], c["begin"] + c["size"]
                        if b > len(text) or a < end or zlib.crc32(text[a:b]) != c["check"]:  # of a row with the same id and another text
                            continue
                        n += 1
                        gone_lines += text.count(b"\n", a, b) + 1
                        pieces.append(text[end:a])
                        end = b + (text[b : b + 1] == b"\n")
                    out = text if not n else b"".join([*pieces, text[end:]])
                    # The last chunk takes the line feed before it along.
                    if n and end >= len(text) and out.endswith(b"\n") and not text.endswith(b"\n"):
                        out = out[:-1]
                    texts.append(out)
                    chunks.append(n)
                    removed.append(gone_lines)
                yield pa.record_batch([part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in (lines, chunks, removed))], ["doc_id", "text", "n_lines", "n_chunks_removed", "n_lines_removed"])

    return rows.mapInArrow(run, "doc_id long, text string, n_lines long, n_chunks_removed long, n_lines_removed long")


def candidates_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, last line) of each candidate: neighbouring lines that aren't both white space, long lines, and lines with text that three or more without stand between."""
    text = data > 32
    black = np.concatenate([[0], np.cumsum(text)])
    starts = text & ~np.concatenate([[False], text[:-1]])
    words = np.concatenate([[0], np.cumsum(starts)])
    told = black[end] > black[begin]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.flatnonzero((row[:-1] == row[1:]) & (told[:-1] | told[1:]))
    long = np.flatnonzero(words[end] - words[begin] > LONG_WORDS)
    spoken = np.flatnonzero(told)
    wide = np.flatnonzero((row[spoken[:-1]] == row[spoken[1:]]) & (np.diff(spoken) > 3))
    return np.concatenate([pair, long, spoken[wide]]), np.concatenate([pair + 1, long, spoken[wide + 1]])


def candidate_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, begin, size, hash of each candidate; begin and size in bytes."""

    def run(batches):
        claim("line_dedup")
        for batch in batches:
            whole, bytes_ = binary(batch.column(1))
            for at, to in blocks(whole):
                data = bytes_[whole[at] : whole[to]]
                offsets = whole[at : to + 1] - whole[at]
                begin, end, first = lines_of(offsets, data)
                start, stop = candidates_of(data, begin, end, first)
                a, b = begin[start], end[stop]
                row = np.searchsorted(first, start, "right") - 1
                yield pa.record_batch([batch.column(0).take(pa.array(at + row)), pa.array(a - offsets[row]), pa.array(b - a), pa.array(hashes_of(data, a, b).view(np.int64))], ["doc_id", "begin", "size", "hash"])

    return docs.select(F.col(id_col).cast("long"), text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).mapInArrow(run, "doc_id long, begin long, size long, hash long")


def whole_repeats(places: list[dict]) -> list[tuple[int, int, int, int]]:
    """(begin, size, earlier document, place there): candidates of a document, those that continue each other in both places put together."""
    out, open_ = [], {}
    for p in sorted(places, key=lambda p: (p["begin"], p["size"])):
        key = p["source"], p["at"] - p["begin"]
        a, b = p["begin"], p["begin"] + p["size"]
        if key in open_ and a <= open_[key][1]:
            open_[key][1] = max(open_[key][1], b)
        else:
            open_[key] = [a, b, *key]
            out.append(open_[key])
    return [(a, b - a, source, a + shift) for a, b, source, shift in out]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, size, bytes of each repeat: by hash these bytes, which stand at an earlier place, stand here as well."""
    with swept(docs.sparkSession) as kept:
        runs, held = _repeats(docs, id_col, text_col)
        kept += [runs, held]
    return runs.join(held, ["source", "at", "size"]).select("doc_id", "begin", "size", "bytes")


def _repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, begin, size, source, at of each repeat, the bytes at the earlier places)."""
    found = written(candidate_table(docs, id_col, text_col).distinct(), "line-candidates")
    # Sums are written before rows are joined with them: Spark splits a skewed join only where both sides come straight from a shuffle.
    first = written(found.groupBy("hash", "size").agg(F.min(F.struct("doc_id", "begin")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-places")
    again = found.join(first, ["hash", "size"]).filter("doc_id <> first.doc_id or begin <> first.begin")
    places = again.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "size", F.col("first.doc_id").alias("source"), F.col("first.begin").alias("at"))).alias("places"))

    def joined(batches):
        claim("line_dedup")
        for batch in batches:
            out = [(i, *r) for i, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in whole_repeats(places)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["doc_id", "begin", "size", "source", "at"])

    runs = written(places.mapInArrow(joined, "doc_id long, begin long, size long, source long, at long"), "line-repeats")
    wanted = runs.select("source", "at", "size").distinct().groupBy("source").agg(F.collect_list(F.struct("at", "size")).alias("places"))
    texts = docs.select(F.col(id_col).cast("long").alias("source"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")

    def fetch(batches):
        claim("line_dedup")
        names, kinds = ["source", "at", "size", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            held, size = [], 0
            for source, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for p in places:
                    held.append((source, p["at"], p["size"], text[p["at"] : p["at"] + p["size"]]))
                    size += p["size"]
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    # Texts are shuffled whatever the size: a small table that is broadcast at first would change the plan as tables grow.
    fetched = texts.join(wanted.hint("merge"), "source").select("source", "text", "places").mapInArrow(fetch, "source long, at long, size long, bytes binary")
    # A place in a row of the same id but another text has other bytes: where they are cut tells them apart.
    held = written(fetched.filter(F.octet_length("bytes") == F.col("size")).distinct(), "earlier-bytes")
    return runs, held


def without(text: bytes, cuts: list[dict]) -> tuple[bytes, int, int]:
    """(text without the places whose bytes are those of a cut, runs removed, lines removed)."""
    spans: list[list[int]] = []
    for c in sorted(cuts, key=lambda c: (c["begin"], c["size"])):
        a, b = c["begin"], c["begin"] + c["size"]
        if text[a:b] != c["bytes"] or a and text[a - 1 : a] != b"\n" or b < len(text) and text[b : b + 1] != b"\n":
            continue
        if spans and a <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    pieces, end = [], 0
    for a, b in spans:
        pieces.append(text[end:a])
        end = b + 1
    out = b"".join([*pieces, text[end:]])
    # The last line takes the line feed before it along.
    if spans and spans[-1][1] == len(text) and out:
        out = out[:-1]
    return out, len(spans), sum(text.count(b"\n", a, b) + 1 for a, b in spans)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_lines, n_chunks_removed (runs of lines), n_lines_removed of each row, `text` without repeats."""
    ready(docs.sparkSession)
    cuts = repeats(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "size", "bytes")).alias("cuts")).hint("merge")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(cuts, "doc_id", "left").select("doc_id", "text", "cuts")

    def run(batches):
        claim("line_dedup")
        for batch in batches:
            whole, _ = binary(batch.column(1))
            for at, to in blocks(whole):
                part = batch.slice(at, to - at)
                texts, counts = [], []
                for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    out, n, gone = without(text, cuts) if text is not None and cuts else (text, 0, 0)
                    texts.append(out)
                    counts.append((0 if text is None else text.count(b"\n") + 1, n, gone))
                yield pa.record_batch([part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True))], ["doc_id", "text", "n_lines", "n_chunks_removed", "n_lines_removed"])

    return rows.mapInArrow(run, "doc_id long, text string, n_lines long, n_chunks_removed long, n_lines_removed long")
