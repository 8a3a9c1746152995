"""Words and word shingles of a text as numpy arrays, from its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: An odd multiplier, so that powers of it have inverses modulo 2^64.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse, to the powers 0 to n - 1, kept between calls."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than white space) of a byte array."""
    ink = np.zeros(len(raw) + 2, np.int8)
    ink[1:-1] = ~_WHITE[raw]
    edge = np.diff(ink)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, whatever its place, then mixed."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    return word_hashes(raw, *word_bounds(raw))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; a shorter text with words is one shingle, one without has none."""
    words = hashed_words(text)
    n = len(words) - width + 1
    if n < 1:
        width, n = len(words), min(1, len(words))
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = mixed(total + words[i : i + n] + np.uint64(i + 1))
    return total
