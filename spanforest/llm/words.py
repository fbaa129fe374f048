"""Words of UTF-8 text as arrays: positions and 64-bit hashes, without a Python object per word.

A word is a longest run of ASCII digits, ASCII letters (lower-cased) and
characters outside ASCII. Every byte of a character outside ASCII is at least
0x80, so bytes can be classified one by one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .common import splitmix

_ODD = 0x9E3779B97F4A7C15 | 1


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    byte = np.arange(256, dtype=np.uint64)
    lower = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
    word = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    value = splitmix(lower * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return lower.astype(np.uint8), word, np.where(word, value, np.uint64(0))


LOWER, IS_WORD, _VALUE = _tables()
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
#: Powers that a worker keeps, enough for a block of texts.
_KEPT = 1 << 21


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant, and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(_ODD, -1, 1 << 64)
        both = []
        for base in (_ODD, inverse):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if n > _KEPT:  # for one very long text: not held until the worker ends
            return both[0], both[1]
        _powers = both[0], both[1]
    return _powers


class Words(NamedTuple):
    doc: np.ndarray  # of each word: the row
    start: np.ndarray  # first byte, from the first byte of the block
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row: its first word; one more at the end


def words(offsets: np.ndarray, data: np.ndarray) -> Words:
    """The words of rows whose bytes are data[offsets[i]:offsets[i + 1]]; offsets[0] is 0."""
    rows, n = len(offsets) - 1, len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_WORD[data]
    # A word ends where a row ends: mark the borders at which both sides are inside.
    edge = inside[1:] != inside[:-1]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < n)]
    joined = np.unique(border[inside[border] & inside[border + 1]])
    starts = np.flatnonzero(edge & inside[1:])
    ends = np.flatnonzero(edge & inside[:-1])
    if len(joined):
        starts = np.sort(np.concatenate([starts, joined]))
        ends = np.sort(np.concatenate([ends, joined]))
    up, down = powers_to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=total[1:])
    hashes = splitmix((total[ends] - total[starts]) * down[starts])
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(rows), np.diff(first))
    return Words(doc, starts, ends, hashes, first)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of `size` words inside one row."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total *= np.uint64(0xC2B2AE3D27D4EB4F)
        total += w.hash[at + j]
    return at, splitmix(total)

