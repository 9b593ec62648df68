"""Suffix arrays of byte strings by induced sorting, with numpy.

Suffixes are classified as S or L; the leftmost S suffixes (LMS) are sorted by
their LMS substrings, recursively: the names of substrings are paired to names
of twice as many substrings until all differ or the wanted depth is covered;
L and S suffixes are then induced bucket by bucket, each bucket in waves. The
order is right for prefixes of ``depth`` bytes, ties beyond it are arbitrary.

Common prefixes of neighbours are permuted to text order, where a value that
follows from the one before (the same neighbour, moved by one) is not compared:
only the irreducible ones are.
"""

from __future__ import annotations

import numpy as np

from .shingles import _INVERSE, _P, _powers, mix


def classify(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S (smaller than the next one)."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    if not len(differs):
        return np.zeros(n, dtype=bool)
    # the type of a run of equal bytes is that of its last byte but the run at the end, which is L
    up = text[differs] < text[differs + 1]
    return np.append(np.repeat(up, np.diff(np.append(-1, differs))), np.zeros(n - 1 - differs[-1], dtype=bool))


def _deal(at: np.ndarray, chars: np.ndarray, pending: list[list[np.ndarray]]) -> None:
    """Appends each suffix to its bucket, in order."""
    order = np.argsort(chars, kind="stable")
    chars, at = chars[order], at[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    begin = 0
    for end in [*cuts.tolist(), len(at)]:
        pending[chars[begin]].append(at[begin:end])
        begin = end


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array, from the LMS suffixes in order (within a bucket as given)."""
    n = len(text)
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(lms):
        _deal(lms, text[lms], seeds)
    l_in: list[list[np.ndarray]] = [[] for _ in range(256)]
    l_in[text[n - 1]].append(np.array([n - 1]))  # the last suffix follows the end of the text, the least of all
    l_out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 256

    def step(wave: np.ndarray, want_s: bool) -> tuple[np.ndarray, np.ndarray]:
        before = wave[wave > 0] - 1
        before = before[is_s[before] == want_s]
        return before, text[before]

    for c in range(256):
        wave, own = _joined(l_in[c]), []
        while len(wave):
            own.append(wave)
            before, chars = step(wave, False)
            wave = before[chars == c]
            far = chars != c
            if far.any():
                _deal(before[far], chars[far], l_in)
        l_out[c] = _joined(own)
        if seeds[c]:
            before, chars = step(_joined(seeds[c]), False)
            if len(before):
                _deal(before, chars, l_in)
    s_in: list[list[np.ndarray]] = [[] for _ in range(256)]
    s_out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 256
    for c in range(255, -1, -1):  # each bucket from its right end
        wave, own = _joined(s_in[c]), []
        while len(wave):
            own.append(wave)
            before, chars = step(wave, True)
            wave = before[chars == c]
            far = chars != c
            if far.any():
                _deal(before[far], chars[far], s_in)
        s_out[c] = _joined(own)[::-1]
        if len(l_out[c]):
            before, chars = step(l_out[c][::-1], True)
            if len(before):
                _deal(before, chars, s_in)
    return np.concatenate([x for c in range(256) for x in (l_out[c], s_out[c])])


def _named(order: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Ranks of positions in order, equal where neighbours have equal values."""
    names = np.empty(len(order), dtype=np.int64)
    names[order] = np.append(0, np.cumsum(value[order][1:] != value[order][:-1]))
    return names


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    n = len(text)
    if n < 2:
        return np.arange(n)
    is_s = classify(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        # LMS substrings come out sorted from inducing with the LMS suffixes in any order
        rank_in_lms = np.full(n, -1)
        rank_in_lms[lms] = np.arange(len(lms))
        by_substring = rank_in_lms[induce(text, is_s, lms)]
        by_substring = by_substring[by_substring >= 0]
        # a substring's value: a hash of its bytes and length; the last one reaches the end
        sums = np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), dtype=np.uint64)
        ends = np.append(lms[1:], n - 1)
        value = mix((sums[ends] - sums[lms - 1]) * _powers(_INVERSE, n)[lms] + (ends - lms).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        value[-1] ^= np.uint64(1)
        names, covered, span = _named(by_substring, value), 2, 1
        order = by_substring
        while covered < depth and names.max() < len(lms) - 1:
            after = np.append(names[span:] + 1, np.zeros(min(span, len(names)), dtype=np.int64))
            pair = names * (len(names) + 1) + after
            order = np.argsort(pair, kind="stable")
            names, covered, span = _named(order, pair), covered * 2, span * 2
        lms = lms[order]
    return induce(text, is_s, lms)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, breaks: np.ndarray, most: int = 256) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, by text position, at most ``most``.

    breaks: positions whose values are always compared; from one of them on, values
    are right for ``most`` less the distance.
    """
    n = len(text)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    reducible = np.zeros(n, dtype=bool)
    reducible[1:] = (phi[1:] > 0) & (text[:-1] == text[np.maximum(phi[1:] - 1, 0)]) & (phi[1:] - 1 == phi[:-1])
    reducible[breaks] = False
    padded = np.append(text, np.zeros(most + 16, dtype=np.uint8))
    words = np.ndarray((n + most + 8,), dtype="<u8", buffer=padded, strides=(1,))
    at = np.flatnonzero(~reducible & (phi >= 0))
    other = phi[at]
    lcp = np.zeros(n, dtype=np.int64)
    live, a, b, k = at, at, other, 0
    while len(live) and k < most:
        x = words[a + k] ^ words[b + k]
        same = x == 0
        low = x & (~x + np.uint64(1))  # the lowest bit that differs
        first = np.zeros(len(x), dtype=np.int64)
        first[~same] = np.floor(np.log2(low[~same].astype(np.float64))).astype(np.int64) // 8
        lcp[live] = k + np.where(same, 8, first)
        live, a, b, k = live[same], a[same], b[same], k + 8
    lcp[at] = np.minimum(lcp[at], n - np.maximum(at, other))
    source = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    return np.maximum(lcp[source] - (np.arange(n) - source), 0)
