"""Token-id files compressed by Re-Pair grammars, with random access.

Documents stand in ascending id order, cut into shards of bounded size. In each
shard the most frequent pair of neighbouring symbols is replaced by a new symbol,
again and again until no pair is frequent; a rule is a pair of symbols made
before it. The shard file keeps the rules and how many ids each rule's symbol
stands for, so a document, or an id inside one, is reached without decoding what
comes before it. Pairs never cross documents.

Layout of a shard (little-endian): magic, seven 64-bit counts, ids of documents
(64 bits) with a null mask, ids and symbols per document (32 bits), rules (two
symbols each), expansion lengths (32 bits), symbols, CRC-32 of all before it.
Symbols are written as their low 16 bits, then a plane for each higher bit.

Defined results: null and empty texts have the end id alone; a null id sorts
first and stays null; repeated rows are written as often as they stand there,
those of one id in any order; an empty table makes no file.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, blocks, claim, get, partitions_for, put, ready, shared_dir, written
from .tokens import loaded, vocabulary

MAGIC = b"RPG3"
#: Ids in a shard before a new one begins: bounds a task's memory.
SHARD_TOKENS = 1 << 21
#: How often a pair must occur to be replaced.
LEAST = 8
#: Compression leaves less time for tokenising: more text at once and more cached pieces than elsewhere.
TEXT_BYTES, CACHE_PIECES = 4 << 20, 2_800_000


class _Pairs:
    """The pairs of a line of symbols that occur often enough, with their exact counts and places.

    A pair can only become frequent when one of its symbols is made, so pairs
    that were too few then are never looked at again, and every other count is
    kept up to date. For a symbol beside itself, whose occurrences can overlap,
    the count is a bound until the pair is the next to be replaced.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, base: int, least: int):
        self.n, self.base, self.least = len(ids), base, least
        n = self.n
        # What is known of a place stands together, as it is read together: from far and wide, at the price of memory.
        grid = np.empty((n + 1, 4), np.int32)
        self.symbol, self.after, self.before, self.pair_at = grid[:, 0].view(np.uint32), grid[:, 1], grid[:, 2], grid[:, 3]
        self.symbol[:n], self.symbol[n] = ids, 0
        # Places of the neighbours in the same document; n is none. A place that is no more has a negative one before it.
        self.after[:], self.before[:] = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(counts)[counts > 0]
        self.after[ends - 1] = self.after[n] = n
        self.before[0] = self.before[ends] = n
        self.pair_at[:] = -1  # of each place: its pair, if it is frequent
        self.often, self.pair, self.twin = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, bool)
        self.lots: list[np.ndarray] = []  # places, those of a pair in a row: its lot, where they begin there and where they end
        self.lot, self.begin, self.end = np.zeros((3, 1 << 12), np.int64)
        self.known = self.made = 0
        self._list(np.flatnonzero(self.after[:n] < n))

    def _list(self, at: np.ndarray) -> None:
        """Lists the pairs at the given places, all of them new."""
        if not len(at):
            return
        bits, places = max(1, (self.base + self.made).bit_length()), self.n.bit_length()
        key = self.symbol[at].astype(np.uint64) << np.uint64(bits) | self.symbol[self.after[at]]
        if 2 * bits + places <= 64:  # sorting numbers takes a fraction of the time of sorting their order
            line = np.sort(key << np.uint64(places) | at.astype(np.uint64))
            line = line[np.concatenate([[True], line[1:] != line[:-1]])]
            key, at = line >> np.uint64(places), line & np.uint64((1 << places) - 1)
        else:
            at, first = np.unique(at, return_index=True)
            order = np.argsort(key[first], kind="stable")
            key, at = key[first][order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(first, len(key)))
        first, many = first[many >= self.least], many[many >= self.least]
        new = len(first)
        if not new:
            return
        while self.known + new > len(self.often):
            for name in ("often", "pair", "twin", "lot", "begin", "end"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        own, key = slice(self.known, self.known + new), key[first]
        left, right = key >> np.uint64(bits), key & np.uint64((1 << bits) - 1)
        ends = np.cumsum(many)
        self.often[own], self.pair[own], self.twin[own] = many, left << np.uint64(32) | right, left == right
        self.lot[own], self.begin[own], self.end[own] = len(self.lots), ends - many, ends
        at = at[np.repeat(first - (ends - many), many) + np.arange(int(ends[-1]))].astype(np.int32)
        self.pair_at[at] = np.repeat(np.arange(self.known, self.known + new, dtype=np.int32), many)
        self.lots.append(at)
        self.known += new

    def _places(self, pair: int) -> np.ndarray:
        """The places a pair was listed at, or of a symbol beside itself those that don't overlap now."""
        at = self.lots[self.lot[pair]][self.begin[pair] : self.end[pair]]
        if self.twin[pair]:
            at = at[self.pair_at[at] == pair]
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(self.pair_at[self.before[at]] != pair, place, 0))
            at = at[(place - run) % 2 == 0]
        return at

    def replace_most_frequent(self) -> np.ndarray | None:
        """Replaces the most frequent pairs; returns them, or None if no pair is frequent.

        Of pairs with the same count those are taken together whose places
        can't overlap, as no right symbol of one is the left symbol of another:
        one after the other they would do the same.
        """
        top = int(self.often[: self.known].max()) if self.known else 0
        if top < self.least:
            return None
        tied = np.flatnonzero(self.often[: self.known] == top)
        taken, held, lefts, rights = [], [], set(), set()
        left, right = (self.pair[tied] >> np.uint64(32)).tolist(), (self.pair[tied] & np.uint64(0xFFFFFFFF)).tolist()
        for p, a, b in zip(tied.tolist(), left, right, strict=True):
            if a in rights or b in lefts or a == b and a in lefts:
                continue
            at = self._places(p)
            if a == b and len(at) < top:
                self.often[p] = len(at)
                continue
            taken.append(p)
            held.append(at)
            lefts.add(a)
            rights.add(b)
        if not taken:
            return np.zeros(0, np.uint64)
        pairs = np.array(taken, np.int32)
        # Indices of 64 bits, which need no conversion each time they are used.
        at, rule = np.concatenate(held).astype(np.intp), np.repeat(np.arange(len(taken)), list(map(len, held)))
        live = self.pair_at[at] == pairs[rule]
        at, rule = at[live], rule[live]
        second = self.after[at].astype(np.intp)
        beyond = self.after[second].astype(np.intp)
        ahead = self.before[at].astype(np.intp)
        self.often[pairs] = 0
        self.symbol[at] = rule + (self.base + self.made)
        self.made += len(pairs)
        # The pairs on both sides are no more; one between two places that are replaced counts once.
        self.pair_at[at] = -1
        lost = [self.pair_at[second]]
        self.pair_at[second] = -1
        lost.append(self.pair_at[ahead])
        self.pair_at[ahead] = -1
        lost = np.concatenate(lost)
        lost = lost[lost >= 0]
        lost = lost[~self.twin[lost]]
        if len(lost) * 40 > self.known:
            self.often[: self.known] -= np.bincount(lost, minlength=self.known).astype(np.int32)
        else:
            np.subtract.at(self.often, lost.astype(np.intp), 1)
        self.before[second] = -1
        self.after[at] = beyond
        self.before[beyond] = at
        ahead = self.before[at].astype(np.intp)
        self._list(np.concatenate([ahead[ahead < self.n], at[beyond < self.n]]))
        return self.pair[pairs]


def compress(ids: np.ndarray, counts: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rules) for documents of `counts` ids each, all below `base`.

    The most frequent pair is replaced, counts are brought up to date, and so on
    until no pair occurs `least` times (occurrences that overlap count once).
    """
    pairs = _Pairs(ids, counts, base, least)
    rules = []
    while (replaced := pairs.replace_most_frequent()) is not None:
        rules.append(replaced)
    live = pairs.before[:-1] >= 0
    whole = np.concatenate([[0], np.cumsum(live)])
    cut = np.concatenate([[0], np.cumsum(counts)])
    rules = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return pairs.symbol[:-1][live], np.diff(whole[cut]), np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule's symbol stands for; a rule names only symbols made before it."""
    size = np.zeros(len(rules), np.int64)
    left = np.ones(len(rules), bool)
    while left.any():
        sides = [np.where(s < base, 1, size[np.maximum(s.astype(np.int64) - base, 0)]) for s in (rules[:, 0], rules[:, 1])]
        done = left & (sides[0] > 0) & (sides[1] > 0)
        if not done.any():
            raise ValueError("a rule names a symbol that is not made before it")
        size[done] = (sides[0] + sides[1])[done]
        left &= ~done
    return size


def _expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    symbols = symbols.astype(np.uint32)
    while len(rules) and (big := symbols >= base).any():
        at = np.arange(len(symbols)) + np.cumsum(big) - big
        out = np.empty(len(symbols) + int(big.sum()), np.uint32)
        rule = rules[symbols[big] - base]
        out[at[~big]] = symbols[~big]
        out[at[big]], out[at[big] + 1] = rule[:, 0], rule[:, 1]
        symbols = out
    return symbols


def _packed(numbers: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each number, then a plane of one bit each for every higher one."""
    numbers = numbers.astype(np.uint32)
    return b"".join([numbers.astype("<u2").tobytes(), *(np.packbits((numbers >> np.uint32(k) & np.uint32(1)).astype(bool)).tobytes() for k in range(16, bits))])


def _unpacked(data: bytes, count: int, at: int, bits: int) -> np.ndarray:
    low = np.frombuffer(data, "<u2", count, at)
    if bits == 16:
        return low
    out, at = low.astype(np.uint32), at + low.nbytes
    for k in range(16, bits):
        plane = np.frombuffer(data, np.uint8, -(-count // 8), at)
        out |= np.unpackbits(plane, count=count).astype(np.uint32) << np.uint32(k)
        at += plane.nbytes
    return out


def dump(doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, counts: np.ndarray, base: int, least: int = LEAST) -> bytes:
    symbols, per, rules = compress(ids, counts, base, least)
    size = expansion_lengths(rules, base)
    bits = max(16, (max(base, int(ids.max(initial=0)) + 1) + len(rules) - 1).bit_length())
    body = b"".join([
        MAGIC, struct.pack("<7Q", len(doc_ids), len(ids), len(symbols), len(rules), base, bits, least),
        doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), counts.astype("<u4").tobytes(), per.astype("<u4").tobytes(),
        _packed(rules.reshape(-1), bits), size.astype("<u4").tobytes(), _packed(symbols, bits),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Shard:
    """A shard file, read; `document` and `part` decode no more than they return, and one rule at either end."""

    doc_ids: np.ndarray
    nulls: np.ndarray
    counts: np.ndarray
    per: np.ndarray
    rules: np.ndarray
    size: np.ndarray
    symbols: np.ndarray
    base: int

    @classmethod
    def load(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("no whole shard file")
        n, _, symbols, rules, base, bits, _ = struct.unpack_from("<7Q", data, 4)
        at, got = 60, []
        for count, kind in ((n, "<i8"), (n, "u1"), (n, "<u4"), (n, "<u4"), (2 * rules, ""), (rules, "<u4"), (symbols, "")):
            got.append(np.frombuffer(data, kind, count, at) if kind else _unpacked(data, count, at, bits))
            at += got[-1].nbytes if kind else 2 * count + (bits - 16) * (-(-count // 8))
        ids, nulls, counts, per, pairs, size, line = got
        return cls(ids, nulls.astype(bool), counts.astype(np.int64), per.astype(np.int64), pairs.reshape(-1, 2).astype(np.uint32), size.astype(np.int64), line, base)

    def all(self) -> np.ndarray:
        """The ids of all documents, in their order."""
        if not len(self.rules):
            return self.symbols.astype(np.uint32)
        if self.base + int(self.size.sum()) > 4 * int(self.counts.sum()):  # few ids, or long rules made of long rules: the table would be larger than the text
            return _expand(self.symbols, self.rules, self.base)
        # What each symbol stands for, all symbols in a row: an id for itself, then the rules.
        flat = np.concatenate([np.arange(self.base, dtype=np.uint32), _expand(np.arange(self.base, self.base + len(self.rules), dtype=np.uint32), self.rules, self.base)])
        sizes = np.concatenate([np.ones(self.base, np.int64), self.size])
        size = sizes[self.symbols]
        source = np.repeat((np.cumsum(sizes) - sizes)[self.symbols] - (np.cumsum(size) - size), size)
        source += np.arange(len(source))
        return flat[source]

    def document(self, i: int) -> np.ndarray:
        at = int(self.per[:i].sum())
        return _expand(self.symbols[at : at + int(self.per[i])], self.rules, self.base)

    def part(self, i: int, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of document i, found by the expansion lengths."""
        at = int(self.per[:i].sum())
        line = self.symbols[at : at + int(self.per[i])].astype(np.int64)
        many = np.where(line >= self.base, self.size[np.maximum(line - self.base, 0)] if len(self.size) else 1, 1)
        ends = np.cumsum(many)
        first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        skip = begin - (int(ends[first - 1]) if first else 0)
        return _expand(line[first:last], self.rules, self.base)[skip : skip + max(0, end - begin)]


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str = "byte_bpe_50k.json", end_id: int = 2, base: int = 50257, shard_tokens: int = SHARD_TOKENS, least: int = LEAST, cache_pieces: int = CACHE_PIECES, folder: str | None = None) -> DataFrame:
    """Writes all documents; the manifest has a row a shard: part, shard, file, n_docs, n_tokens, n_bytes, start."""
    spark = docs.sparkSession
    ready(spark)
    folder = folder or shared_dir(spark, "token-shards")

    def run(batches):
        claim("tokens")
        part, tokenizer = TaskContext.get().partitionId(), loaded(vocabulary(vocab), cache_pieces)
        held: list[tuple] = []
        shard = size = 0

        def close():
            ids, nulls, line, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            data = dump(ids, nulls, line, counts, base, least)
            uri = f"{folder}/part-{part:06d}-{shard:06d}.rpg"
            put(uri, data)
            return pa.record_batch({"part": [part], "shard": [shard], "file": [uri], "n_docs": [len(ids)], "n_tokens": [len(line)], "n_bytes": [len(data)]})

        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            nulls = keys.is_null().to_numpy(zero_copy_only=False)
            keys = keys.fill_null(0).to_numpy()
            offsets, _ = binary(batch.column(1))
            for at, to in blocks(offsets, TEXT_BYTES):
                ids, counts = tokenizer.encode_column(batch.column(1).slice(at, to - at), end_id)
                held.append((keys[at:to], nulls[at:to], ids, counts))
                size += len(ids)
                if size >= shard_tokens:
                    yield close()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield close()

    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    manifest = written(ordered.mapInArrow(run, "part long, shard long, file string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")
    # Prefix sums over a row for each partition, then inside each partition.
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(line), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(bases, "part").select(manifest["*"], (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))


def read_shards(manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids: every document, decoded from the files.

    Without `with_ids` the ids are decoded and summed, and not handed on.
    """
    ready(manifest.sparkSession)

    def run(batches):
        claim("tokens")
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard.load(get(uri))
                ids = np.ascontiguousarray(shard.all(), "<u4")
                cut = np.concatenate([[0], np.cumsum(shard.counts)])
                view = memoryview(ids).cast("B")
                for at, to in blocks(cut * 4):
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cut[at:to].tolist(), cut[at + 1 : to + 1].tolist(), strict=True)]
                    own, ends = ids[cut[at] : cut[to]], (cut[at : to + 1] - cut[at]) * 4
                    if not with_ids:
                        own, ends = own[:0], ends * 0
                    data = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own)])
                    yield pa.record_batch([pa.array(shard.doc_ids[at:to], mask=shard.nulls[at:to]), pa.array(start + cut[at:to]), pa.array(shard.counts[at:to]), pa.array(crc, pa.int64()), data], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = manifest.select("file", "start").repartition(partitions_for(manifest.sparkSession), "file")
    read = files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return read if with_ids else read.drop("ids")
