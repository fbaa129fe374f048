"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

The library's own pre-tokenisation never joins what stands before a space and
what stands from that space on if a character that is no white space follows,
and a line feed between two characters that are none is a token of its own. So
texts are cut there, each distinct piece is encoded once by the library,
and the ids of a text are the ids of its pieces in a row. A piece of Latin letters
is one word to the pre-tokenisation, so it goes to the library's model at once; a
punctuation mark after it is a word of its own, whose id is put behind those of the letters. Pieces are kept in a
cache of bounded size. Encoding and special-token handling equal
`encode_batch(texts, add_special_tokens=False)` with `encode_special_tokens`.
"""

from __future__ import annotations

import contextlib
import gc
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CLEARED, binary

#: Distinct pieces kept by one Python worker, 90 bytes each, or 230 if longer than 15 bytes; above it the cache starts anew.
CACHE_PIECES = 500_000
#: Bytes of texts that are encoded in one call.
TEXT_BYTES = 2 << 20
#: Pieces that are encoded in one call.
_CALL = 4096

_UNSAFE = re.compile(r" (?:\s|᠎|\Z)")
_CONTROL = re.compile(r"[\t\x0b-\x1f]")
#: Latin letters (ASCII, Latin-1, Latin Extended A and B), and the ASCII marks that can follow without an apostrophe among them.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
#: The same marks.
_IS_MARK = np.array([33 <= b < 127 and b != 39 and not chr(b).isalnum() for b in range(256)])
_CUT = re.compile(r"(?= [^\s᠎])")


def _unsafe(text: str) -> bool:
    """Whether a space stands before white space or at the end, so that not every space begins a piece."""
    if text.isascii() and "  " not in text and " \n" not in text and text[-1:] != " " and not _CONTROL.search(text):
        return False
    return _UNSAFE.search(text) is not None


def _bare(piece: str) -> bool:
    return bool(piece) and "\n" not in piece and not piece[0].isspace() and not piece[-1].isspace()


class _Table:
    """Numbers of byte strings of at most 15 bytes, each kept whole: its bytes, its length and its kind in two words."""

    MOST = 15
    #: The low bytes of a word.
    _LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        # Two words and a number from 1 on, 0 where the row is free; of 32 bytes, so that a row is in one cache line.
        self.rows = np.zeros((1 << bits, 4), np.uint64)

    @classmethod
    def keys(cls, offsets: np.ndarray, data: np.ndarray, kind: int) -> np.ndarray:
        """The two words of each string; those of longer ones mean nothing."""
        size = np.minimum(np.diff(offsets), cls.MOST)
        wide = np.concatenate([data, np.zeros(16, np.uint8)])
        word = np.ndarray(len(data) + 9, "<u8", wide, strides=(1,))
        key = np.empty((len(size), 2), np.uint64)
        key[:, 0] = word[offsets[:-1]] & cls._LOW[np.minimum(size, 8)]
        key[:, 1] = word[np.minimum(offsets[:-1] + 8, len(data) + 8)] & cls._LOW[np.maximum(size - 8, 0)] | (size + 16 * kind).astype(np.uint64) << np.uint64(56)
        return key

    def _slots(self, key: np.ndarray) -> np.ndarray:
        mixed = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.intp)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The number of each string, -1 if it has none."""
        out = np.full(len(key), -1, np.int64)
        at, slot = np.arange(len(key)), self._slots(key)
        while len(at):
            row = self.rows[slot]
            taken = row[:, 2] > 0
            same = taken & (row[:, 0] == key[:, 0]) & (row[:, 1] == key[:, 1])
            out[at[same]] = row[same, 2].astype(np.int64) - 1
            on = np.flatnonzero(taken & ~same)
            at, key, slot = at[on], key[on], (slot[on] + 1) & (len(self.rows) - 1)
        return out

    def put(self, key: np.ndarray, numbers: np.ndarray) -> None:
        """Adds different strings that are not there."""
        if self.used + len(key) > 0.7 * len(self.rows):
            old = self.rows[self.rows[:, 2] > 0]
            while self.used + len(key) > 0.7 * (1 << self.bits):
                self.bits += 1
            self.rows, self.used = np.zeros((1 << self.bits, 4), np.uint64), 0
            self.put(old[:, :2], old[:, 2].astype(np.int64) - 1)
        self.used += len(key)
        own, slot = numbers.astype(np.uint64) + np.uint64(1), self._slots(key)
        while len(own):
            free = np.flatnonzero(self.rows[slot, 2] == 0)
            self.rows[slot[free], 2] = own[free]  # of several at one row the last has it
            got = self.rows[slot, 2] == own
            self.rows[slot[got], :2] = key[got]
            own, key, slot = own[~got], key[~got], (slot[~got] + 1) & (len(self.rows) - 1)


class PieceTokenizer:
    """Encodes lists of texts to one flat array of ids with each text's count.

    The piece cut is exact for the byte-level pre-tokeniser without added
    leading space; `exact` is False for any other file, whose texts are then
    encoded whole.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.cache_pieces = cache_pieces
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = str(self.tokenizer.pre_tokenizer)
        self.exact = "ByteLevel(" in kind and "add_prefix_space=False" in kind and "use_regex=True" in kind and "Sequence" not in kind and self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        feed = self.tokenizer.encode("a\na", add_special_tokens=False).ids
        self.feed = feed[1] if len(feed) == 3 and feed[0] == feed[2] else None
        # Words can go to the model if no added token can stand in them.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model if self.exact and not any(_WORD.fullmatch(t) or _WORD.fullmatch("a" + t) for t in added) else None
        # How the byte-level alphabet writes bytes, the printable ones as themselves and the others from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = itertools.count(256)
        self.alphabet = {b: b if b in printable else next(others) for b in range(256)}
        self.marks: dict[str, list[int]] = {"": []}
        self._clear()

    def _clear(self) -> None:
        # Pieces as Arrow cuts them stand in the table; the others, and those too long for it, in these.
        self.plain: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.table = _Table()
        self.ends: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int32)
        self.count = np.zeros(1 << 16, np.int32)
        self.used = self.pieces = 0  # ids that are kept, and pieces

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(counts.sum())), counts

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.pieces > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.count[numbers] = counts
        self.begin[numbers] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _numbered(self, known: dict[str, int], pieces: list[str]) -> tuple[np.ndarray, list[str], range]:
        """(the number of each piece, the pieces that had none, their numbers)."""
        found = np.fromiter(map(known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        new = [pieces[i] for i in missing.tolist()]
        own = dict(zip(dict.fromkeys(new), itertools.count(self.pieces), strict=False))
        numbers = range(self.pieces, self.pieces + len(own))
        self.pieces += len(own)
        found[missing] = numbers if len(own) == len(new) else [own[p] for p in new]
        known.update(own)
        return found, list(own), numbers

    def _tabled(self, known: dict[str, int], pieces: pa.Array, lead: str) -> tuple[np.ndarray, list[str], list[int]]:
        """The same for different pieces in an Arrow array, by the table."""
        offsets, data = binary(pieces)
        key = self.table.keys(offsets, data, 1 if lead else 0)
        found = self.table.get(key)
        long = np.diff(offsets) > self.table.MOST
        missing = np.flatnonzero((found < 0) & ~long)
        found[missing] = np.arange(self.pieces, self.pieces + len(missing))
        self.pieces += len(missing)
        self.table.put(key[missing], found[missing])
        new, numbers = pieces.take(pa.array(missing)).to_pylist(), found[missing].tolist()
        if long.any():
            found[long], more, more_at = self._numbered(known, pieces.filter(pa.array(long)).to_pylist())
            new += more
            numbers += more_at
        return found, new, numbers

    def _words(self, known: dict[str, int], new: list[str], numbers: range | list[int], lead: str) -> tuple[list[str], list[int]]:
        """Encodes the new pieces that are letters, or letters and marks; returns the others and their numbers."""
        if not new:
            return [], []
        # Of pieces in ASCII: letters up to `first`, and nothing but marks from there on.
        offsets, data = binary(pa.array(new, pa.string()))
        begin, end = offsets[:-1], offsets[1:]
        letter = (data | np.uint8(32)) - np.uint8(97) < 26
        first = np.append(np.flatnonzero(~letter), len(data))
        first = np.minimum(first[np.searchsorted(first, begin)], end)
        mark = np.concatenate([[0], np.cumsum(_IS_MARK[data])])
        size = np.where((first > begin) & (mark[end] - mark[first] == end - first), first - begin, 0)
        bare, bare_at, marked_at, stems, after, others, others_at = [], [], [], [], [], [], []
        for p, number, letters in zip(new, numbers, size.tolist(), strict=True):
            if not letters and not p.isascii() and (word := _WORD.fullmatch(p)):
                letters = word.end(1)
            if letters == len(p):
                bare.append(p)
                bare_at.append(number)
            elif letters:
                marked_at.append(number)
                stems.append(p[:letters])
                after.append(p[letters:])
            else:
                others.append(p)
                others_at.append(number)
        cut = pa.array(stems, pa.string()).dictionary_encode()
        stem_at, more, more_at = self._tabled(known, cut.dictionary, lead)
        stems = stem_at[cut.indices.to_numpy()]
        bare += more
        bare_at += more_at
        if bare:
            space, split, alphabet = "\u0120" if lead else "", self.model.tokenize, self.alphabet
            ids = [[t.id for t in split(space + (p if p.isascii() else p.encode().decode("latin-1").translate(alphabet)))] for p in bare]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(np.array(bare_at, np.int64), np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())), counts)
        if marked_at:
            for m in set(after) - self.marks.keys():
                self.marks[m] = self.tokenizer.encode(m, add_special_tokens=False).ids
            more = [self.marks[m] for m in after]
            size, own = np.fromiter(map(len, more), np.int64, len(more)), self.count[stems]
            counts = size + own
            ends = np.cumsum(counts)
            place = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts)
            letters = place < np.repeat(own, counts)
            ids = np.empty(len(place), np.uint32)
            ids[letters] = self.flat[(np.repeat(self.begin[stems], counts) + place)[letters]]
            ids[~letters] = np.fromiter(itertools.chain.from_iterable(more), np.uint32, int(size.sum()))
            self._keep(np.array(marked_at, np.int64), ids, counts)
            if len(self.marks) > 1 << 16:
                self.marks = {"": []}
        return others, others_at

    def _numbers(self, known: dict[str, int], pieces: list[str], lead: str) -> np.ndarray:
        found, new, number_of = self._numbered(known, pieces)
        self._keep_new(known, new, number_of, lead)
        return found

    def _keep_new(self, known: dict[str, int], new: list[str], number_of: range | list[int], lead: str) -> None:
        """Encodes pieces that have a number and nothing else."""
        if self.model is not None:
            new, number_of = self._words(known, new, number_of, lead)
        for i in range(0, len(new), _CALL):
            part = new[i : i + _CALL]
            numbers = np.array(number_of[i : i + _CALL], np.int64)
            ids = counts = None
            if not lead and self.feed is not None and all(map(_bare, part)):
                # Words with a line feed between, which is one token.
                ids = np.asarray(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                cut = np.flatnonzero(ids == self.feed)
                if len(cut) == len(part) - 1:
                    counts = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                    ids = np.delete(ids, cut)
                else:
                    ids = None
            if lead:
                # Pieces without a space inside: a token with a leading space starts each.
                text = lead + lead.join(part)
                if text.count(" ") == len(part):
                    ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                    first = np.flatnonzero(self.leads[ids])
                    if len(first) == len(part) and (len(first) == 0 or first[0] == 0):
                        counts = np.diff(np.append(first, len(ids)))
                    else:
                        ids = None
            if ids is None:
                ids, counts = self._encode([lead + p for p in part])
            self._keep(numbers, ids, counts)

    def _end(self, end_id: int) -> int:
        """The number of a piece that is the end id."""
        if end_id not in self.ends:
            self.ends[end_id] = self.pieces
            self.pieces += 1
            self._keep(np.array([self.ends[end_id]]), np.array([end_id], np.uint32), np.ones(1, np.int64))
        return self.ends[end_id]

    def _in_line(self, sizes: np.ndarray, lines_of: np.ndarray, heads: np.ndarray, tails: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts, pieces of each text): lines of `sizes` pieces each, the first a head, texts of `lines_of` lines each."""
        # After each line but a text's last comes a line feed, after the last the end id, if there is one.
        last = np.zeros(len(sizes), bool)
        last[np.cumsum(lines_of) - 1] = True
        ended = end_id is not None
        size = sizes + np.where(last, int(ended), 1)
        after = np.cumsum(size)
        first = after - size
        index = np.empty(int(after[-1]) if len(after) else 0, np.int64)
        others = np.ones(len(index), bool)
        others[first] = False
        if ended:
            others[after[last] - 1] = False
            index[after[last] - 1] = self._end(end_id)
        if not last.all():
            others[after[~last] - 1] = False
            index[after[~last] - 1] = self._end(self.feed)
        index[first] = heads
        index[others] = tails
        return index, np.diff(after[last], prepend=0)

    def _whole(self, index: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of texts of so many pieces each."""
        counts = self.count[index]
        ends = np.cumsum(counts)
        source = np.repeat(self.begin[index] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[source], np.diff(np.concatenate([[0], ends])[np.cumsum(pieces)], prepend=0)

    def _listed(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        heads: list[str] = []
        tails: list[str] = []
        sizes: list[int] = []  # pieces of each line, without line feeds
        lines_of: list[int] = []
        for text in texts:
            lines = [text]
            if self.feed is not None and "\n" in text:
                lines = text.split("\n")
                if not all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
                    lines = [text]
            for line in lines:
                if _unsafe(line):
                    parts = _CUT.split(line)
                    parts[1:] = [p[1:] for p in parts[1:]]
                else:
                    parts = line.split(" ")
                sizes.append(len(parts))
                heads.append(parts.pop(0))
                tails += parts
            lines_of.append(len(lines))
        return self._in_line(np.array(sizes, np.int64), np.array(lines_of, np.int64), self._numbers(self.plain, heads, ""), self._numbers(self.spaced, tails, " "), end_id)

    @contextlib.contextmanager
    def _uncollected(self) -> Iterator[None]:
        """Millions of short-lived objects hold no rings: looking for some takes a fifth of the time."""
        on = gc.isenabled()
        gc.disable()
        try:
            yield
        finally:
            if on:
                gc.enable()

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts in a row, ids per text), with end_id after each text if one is given."""
        if not self.exact:
            ids, counts = self._encode(texts)
            return (ids, counts) if end_id is None else (np.insert(ids, np.cumsum(counts), end_id), counts + 1)
        if self.pieces > self.cache_pieces:
            self._clear()
        with self._uncollected():
            return self._whole(*self._listed(texts, end_id))

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for an Arrow column of strings, null as empty. Texts that are cut at every space and line feed are cut by Arrow."""
        if not self.exact or self.feed is None:
            return self.encode([t or "" for t in column.to_pylist()], end_id)
        if self.pieces > self.cache_pieces:
            self._clear()
        with self._uncollected():
            return self._whole(*self._cut(column, end_id))

    def _cut(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts, pieces of each text)."""
        plain = _plainly_spaced(*binary(column))
        if not plain.any():
            return self._listed([t or "" for t in column.to_pylist()], end_id)
        lines = pc.split_pattern(column.filter(pa.array(plain)), "\n")
        pieces = pc.split_pattern(lines.flatten(), " ")
        sizes = np.diff(pieces.offsets.to_numpy())
        cut = pieces.flatten().dictionary_encode()
        at = cut.indices.to_numpy()
        first = np.zeros(len(at), bool)
        first[np.cumsum(sizes) - sizes] = True
        found = []
        for own, kind, lead in ((at[first], self.plain, ""), (at[~first], self.spaced, " ")):
            number = np.zeros(len(cut.dictionary), np.int64)
            number[own] = 1
            used = np.flatnonzero(number)
            number[used], new, number_of = self._tabled(kind, cut.dictionary.take(pa.array(used)), lead)
            self._keep_new(kind, new, number_of, lead)
            found.append(number[own])
        index, size = self._in_line(sizes, np.diff(lines.offsets.to_numpy()), *found, end_id)
        if not plain.all():
            more, many = self._listed([t or "" for t in column.filter(pa.array(~plain)).to_pylist()], end_id)
            # The two lots of texts, dealt to their places in the column.
            order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
            index, size = np.concatenate([index, more]), np.concatenate([size, many])
            begin = (np.cumsum(size) - size)[order]
            size = size[order]
            ends = np.cumsum(size)
            index = index[np.repeat(begin - (ends - size), size) + np.arange(len(index))]
        return index, size


def _plainly_spaced(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Of each text, whether it has text in each line, white space neither at the lines' ends nor beside another blank; never for empty ones."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    opens = (data - np.uint8(9) < 5) | (data - np.uint8(28) < 5)  # ASCII white space, as str.isspace has it
    closes = opens
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if len(lead):  # white space outside ASCII, and the vowel separator that the cut takes for one
        wide = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        code = np.where(wide[lead] == 0xC2, (wide[lead] & 31) << 6 | wide[lead + 1] & 63, (wide[lead] & 15) << 12 | (wide[lead + 1] & 63) << 6 | wide[lead + 2] & 63)
        space = lead[np.isin(code, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
        closes = opens.copy()
        opens[space] = True
        closes[space + np.where(data[space] == 0xC2, 1, 2)] = True
    bad = np.zeros(len(data), bool)
    if len(data):
        bad[:-1] = ((data[:-1] == 32) | (data[:-1] == 10)) & opens[1:] | (data[1:] == 10) & closes[:-1]
    good = size > 0
    good[good] = ~(opens[offsets[:-1][good]] | closes[offsets[1:][good] - 1])
    good[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
    return good[:rows]


_loaded: dict[str, PieceTokenizer] = {}
CLEARED.append(_loaded.clear)


def loaded(path: str, cache_pieces: int = CACHE_PIECES) -> PieceTokenizer:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = PieceTokenizer(path, cache_pieces)
    _loaded[path].cache_pieces = cache_pieces
    return _loaded[path]


def vocabulary(path: str = "") -> str:
    """The file's place on this machine: a path as it is, a bare name by the installed package."""
    if path and "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path or "byte_bpe_50k.json")
