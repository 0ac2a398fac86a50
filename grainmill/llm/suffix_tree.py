"""Maximal repeats of a set of byte strings from an enhanced suffix array.

The suffixes of all strings are sorted by doubling (ranks by 7, 14, 28, ... bytes; the end of a string counts below all
bytes). Lengths of common prefixes of neighbours come from the same ranks. A stack scan over them yields the nodes of
the interval tree: an interval is a set of places that share `least` or more bytes, more than with any place outside.
A node whose places are preceded by different bytes (or by a string's beginning) cannot be extended to the left, so it is
a maximal repeat, reported with all its places.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 7  # of 9 bits each


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate(([1], (ranked[1:] != ranked[:-1]).astype(np.int64))))
    return out


def rank_levels(data: np.ndarray, end: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(k, ranks of all places by their first k bytes) for k = 7, 14, ... up to the longest string; end: of each place's string."""
    n = len(data)
    place = np.arange(n)
    symbol = data.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for t in range(_SYMBOLS):
        key <<= 9
        inside = place + t < end
        key[inside] |= symbol[place[inside] + t]
    levels, k, rank = [], _SYMBOLS, _dense(key)
    levels.append((k, rank))
    while k < longest:
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(place + k < end)
        after[inside] = rank[inside + k]
        rank = _dense((rank << 32) | after)
        k *= 2
        levels.append((k, rank))
    return levels


def common_prefixes(data: np.ndarray, end: np.ndarray, levels: list[tuple[int, np.ndarray]], order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it (0 for the first)."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    stop_a, stop_b = end[a], end[b]
    top = np.minimum(stop_a - a, stop_b - b)
    got = np.zeros(len(a), np.int64)
    last = len(data) - 1
    for k, rank in reversed(levels):
        same = (got < top) & (rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)])
        got[same] += k
    for _ in range(_SYMBOLS - 1):
        same = (got < top) & (data[np.minimum(a + got, last)] == data[np.minimum(b + got, last)])
        got[same] += 1
    return np.concatenate(([0], np.minimum(got, top)))


def scan(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the interval tree with `least` or more common bytes: first and last position in the order, common bytes."""
    found: list[tuple[int, int, int]] = []
    deep = lcp >= least
    if not deep.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    turn = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
    for lo, hi in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        if hi - lo == 1:
            found.append((lo - 1, lo, int(lcp[lo])))
            continue
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate(lcp[lo:hi].tolist(), lo):
            left = i - 1
            while stack and stack[-1][0] > depth:
                d, left = stack.pop()
                found.append((left, i - 1, d))
            if not stack or stack[-1][0] < depth:
                stack.append((depth, left))
        while stack:
            d, left = stack.pop()
            found.append((left, hi - 1, d))
    out = np.array(found, np.int64)
    return out[:, 0], out[:, 1], out[:, 2]


def maximal_repeats(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, first, length): group g is the string of length[g] bytes at places[first[g]:first[g + 1]]; strings lie in data[offsets[i]:offsets[i + 1]]."""
    sizes = np.diff(offsets)
    end = np.repeat(offsets[1:], sizes)
    starts = np.flatnonzero(end - np.arange(len(data)) >= least)
    if len(starts) < 2:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    levels = rank_levels(data, end, int(sizes.max()))
    order = starts[np.argsort(levels[-1][1][starts], kind="stable")]
    lcp = common_prefixes(data, end, levels, order)
    lo, hi, length = scan(lcp, least)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    before = np.where(begins[order], -1, data[np.maximum(order - 1, 0)].astype(np.int64))
    changes = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))))
    diverse = (changes[hi] > changes[lo]) | (before[lo] < 0)
    lo, hi, length = lo[diverse], hi[diverse], length[diverse]
    counts = hi - lo + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    return order[np.repeat(lo - first[:-1], counts) + np.arange(first[-1])], first, length
