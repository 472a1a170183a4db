"""Word-shingle sets of texts as sorted 64-bit hashes, made by array operations over a text's bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _BASE_INVERSE))
    return _powers


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words and the bytes after them."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of the bytes first..after for each span, whatever stands around it."""
    powers, inverses = _powers_to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
    return mixed((sums[after] - sums[first]) * inverses[first] + (after - first).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each lower-cased word."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    return span_hashes(data, *word_bounds(data)) if len(data) else np.empty(0, np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the runs of ``words`` words; of all words if there are fewer; empty without a word."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    out = np.full(len(hashes) - n + 1, np.uint64(n))
    for i in range(n):
        out = out * _BASE + hashes[i : len(hashes) - n + 1 + i]
    return np.unique(mixed(out))
