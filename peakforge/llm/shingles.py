"""Word hashes and word shingles of a block of texts, computed on its bytes with numpy."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
MASK = (1 << 64) - 1
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers(dict):
    """Powers by base, as far as they were needed; executors start without any."""

    def __reduce__(self):
        return Powers, ()


_CACHE = Powers()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    have = _CACHE.get(int(base))
    if have is None or len(have) < n:
        have = np.full(1 << max(n, 1).bit_length(), base, dtype=np.uint64)
        have[0] = 1
        have = _CACHE[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def word_hashes(data: bytes, bounds: np.ndarray, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) for texts that stand one after the other in data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    inside = ~separators[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), dtype=np.uint64)
    before = np.where(first > 0, sums[np.maximum(first - 1, 0)], np.uint64(0))
    value = (sums[last] - before) * _powers(_INVERSE, n)[first]
    value = mix(value + (last - first + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    counts = np.searchsorted(first, bounds[1:]) - np.searchsorted(first, bounds[:-1])
    return value, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, number of runs of each text); a shorter text that has a word is one run."""
    ends = np.cumsum(counts)
    begins = ends - counts
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.repeat(begins - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    room = np.repeat(ends, runs)
    out = np.zeros(len(offsets), dtype=np.uint64)
    for j in range(size):
        at = offsets + j
        there = at < room
        part = mix(words[np.where(there, at, 0)] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & MASK)) if len(words) else out
        out += np.where(there, part, np.uint64(0))
    return mix(out), runs
