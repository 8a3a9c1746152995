"""DartMinHash: signatures of weighted sets whose agreement estimates weighted Jaccard (Christiani, 2020).

Over each element stands a board of weight by rank, on which a hash of the element throws darts at rate one. A set sees
the darts below its weights. Each dart also falls to one of k coordinates, and the earliest dart that a set sees in a
coordinate (that of least rank) is the coordinate's value. Two sets see the same earliest dart with a probability of
their weighted Jaccard. Only ranks below t / total weight have to be thrown, about k ln k + 3 k darts for a whole set
whatever its size; where a coordinate stays empty, ranks are thrown further.
"""

from __future__ import annotations

import math

import numpy as np

from .shingles import mixed

_STEP, _LAYER, _COORD = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03, np.uint64(0x8CB92BA72F3D8DD7)


def _strip(ids: np.ndarray, low: float, high: float, weights: np.ndarray, until: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, coordinates and values of the darts that fall below ``weights`` with weight in [low, high), rank < until.

    In a strip of width w the ranks of an element's darts are the arrivals of a Poisson process of rate w.
    """
    width, found = high - low, []
    active, at, j = np.arange(len(ids)), np.zeros(len(ids)), 0
    block = max(1, min(4096, math.ceil(until * width)))
    while len(active):
        steps = (np.arange(j + 1, j + block + 1).astype(np.uint64) * _STEP)[None, :]
        h = mixed(ids[active][:, None] + steps)
        gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
        ranks = at[:, None] + np.cumsum(gaps, axis=1)
        g = mixed(h ^ _COORD)
        seen = ranks < until
        if high > 1.0 or weights.min() < 1.0:
            place = low + width * (mixed(g) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            seen &= place < weights[active][:, None]
        found.append((ranks[seen], (g[seen] >> np.uint64(20)) % np.uint64(k), g[seen]))
        going = ranks[:, -1] < until
        active, at, j = active[going], ranks[going, -1], j + block
    return tuple(np.concatenate(x) for x in zip(*found))


def signature(elements: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray | None:
    """k values (uint64) of the set of ``elements`` (distinct uint64 hashes); None for a set without weight."""
    weights = np.ones(len(elements)) if weights is None else weights
    elements, weights = elements[weights > 0], weights[weights > 0]
    if not len(elements):
        return None
    until = k * (math.log(k) + 3) / weights.sum()
    while True:
        parts, low, high, layer = [], 0.0, 1.0, 0
        while (inside := weights > low).any():
            ids = mixed(elements[inside] ^ np.uint64((layer * _LAYER) % 2**64))
            parts.append(_strip(ids, low, high, weights[inside], until, k))
            low, high, layer = high, high * 2, layer + 1
        ranks, coords, values = (np.concatenate(x) for x in zip(*parts))
        out, full = np.zeros(k, np.uint64), np.zeros(k, bool)
        late = np.argsort(-ranks, kind="stable")  # the earliest is written last
        out[coords[late]] = values[late]
        full[coords] = True
        if full.all():
            return out
        until *= 2


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One int64 for each band of equally many coordinates; keys of different bands differ."""
    rows = sig.reshape(bands, -1)
    total = np.arange(1, bands + 1).astype(np.uint64) * _STEP
    for column in rows.T:
        total = mixed(total ^ column)
    return total.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)
