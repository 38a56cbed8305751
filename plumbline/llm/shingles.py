"""Words and word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1024, _BASE, dtype=np.uint64))
#: Bounds of words: space and the five controls from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with A-Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, and the bytes where each begins and ends."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inner = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    longest = int((ends - starts).max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _BASE, dtype=np.uint64))
    lengths = ends - starts
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = (raw[inner[1:-1]].astype(np.uint64) + np.uint64(1)) * powers[at]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64)), starts, ends


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in text order; fewer words are one run, none are none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        out = out * _BASE + hashes[j : n - width + 1 + j]
    return mix(out)


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(runs(words(text)[0], size))
