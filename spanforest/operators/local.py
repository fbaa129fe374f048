"""Rounds of lightest edges over arrays, for what one task can hold."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Edges that one task finishes: 24 bytes each in its arrays, a few times over.
FINISH_EDGES = 2_000_000


class LocalRound(NamedTuple):
    chosen: np.ndarray  # rids
    live_edges: int
    components: int


def local_rounds(cu: np.ndarray, cv: np.ndarray, rid: np.ndarray) -> tuple[list[LocalRound], np.ndarray, np.ndarray]:
    """The same rounds over arrays: (rounds, components, the root of each)."""
    names, flat = np.unique(np.concatenate([cu, cv]), return_inverse=True)
    order = np.argsort(rid, kind="stable")
    a, b, rid = flat[: len(cu)][order], flat[len(cu) :][order], rid[order]
    root = np.arange(len(names))
    rounds = []
    while len(a):
        n, place = len(names), np.arange(len(a))
        best = np.full(n, len(a))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        at = np.flatnonzero(best < len(a))
        taken = best[at]
        rounds.append(LocalRound(rid[np.unique(taken)], len(a), len(at)))
        to = np.arange(n)
        to[at] = np.where(a[taken] == at, b[taken], a[taken])
        mutual = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[mutual] = np.flatnonzero(mutual)
        while (to[to] != to).any():
            to = to[to]
        root = to[root]
        x, y = to[a], to[b]
        a, b = np.minimum(x, y), np.maximum(x, y)
        apart = np.flatnonzero(a != b)
        # Sorted by order, so the first of parallel edges is the one to keep.
        _, first = np.unique(a[apart] * n + b[apart], return_index=True)
        keep = apart[np.sort(first)]
        a, b, rid = a[keep], b[keep], rid[keep]
    return rounds, names, names[root] if len(names) else names
