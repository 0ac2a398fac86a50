"""Context-tree weighting on counts of byte n-grams.

A byte is eight binary decisions, most significant bit first; every context (the 0 to `depth` bytes before) has a node
for each of the 255 bit prefixes. A node's Krichevsky-Trofimov estimate is mixed half and half with the product of its
children, the contexts one byte longer, from the deepest level up:

    Pw(c) = (KT(c) + prod Pw(xc)) / 2,  and Pw(c) = KT(c) at the deepest level.

Trained once, the tree is fixed, so each node's share KT / (2 Pw) gives the weight of its own estimate against its
subtree's, and every (context, byte) has one probability. They are laid out as a table of log10 probabilities, a row of
256 floats for each kept context, for scoring by plain lookups. Contexts that the caller dropped as too rare are missing
from the levels; what they saw enters their parent's product as one more leaf. A path of contexts ends where no training
data went.

The contexts that end in the same bytes are a subtree of their own: climb() gives its root's weighted probabilities,
descend() its rows from what stands above it. So a tree can be fitted subtree by subtree (scoring.py), or whole
(ContextTree).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOGS = 64
_HALF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_LOGS) + 0.5))))
_FULL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_LOGS) + 1.0))))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log of the KT estimator's probability of any sequence with so many zeros and ones."""

    def rising(n: np.ndarray, table: np.ndarray, shift: float, at_zero: float) -> np.ndarray:
        return np.where(n <= _LOGS, table[np.minimum(n, _LOGS).astype(np.int64)], _log_gamma(np.maximum(n, 1.0) + shift) - at_zero)

    half = 0.5723649429247001  # log gamma(1/2)
    return rising(zeros, _HALF, 0.5, half) + rising(ones, _HALF, 0.5, half) - rising(zeros + ones, _FULL, 1.0, 0.0)


def bit_nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the next byte (n, 256) as zeros and ones at the 255 nodes (n, 255), node 2**level - 1 + prefix."""
    zeros, ones = np.empty((len(counts), 255)), np.empty((len(counts), 255))
    for level in range(8):
        pair = counts.reshape(len(counts), 2**level, 2, -1).sum(-1)
        at = slice(2**level - 1, 2 ** (level + 1) - 1)
        zeros[:, at], ones[:, at] = pair[:, :, 0], pair[:, :, 1]
    return zeros, ones


_BYTE = np.arange(256)
_NODE = np.stack([2**level - 1 + (_BYTE >> (8 - level)) for level in range(8)], 1)
_BIT = np.stack([_BYTE >> (7 - level) & 1 for level in range(8)], 1).astype(bool)


def byte_log10(one: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability from the nodes' probabilities of a one."""
    yes, no = np.log10(one), np.log10(1 - one)
    out = np.zeros((len(one), 256))
    for level in range(8):
        node = _NODE[:, level]
        out += np.where(_BIT[:, level], yes[:, node], no[:, node])
    return out


class Places:
    """An open hash table from 64-bit keys to their places in the list of keys; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * max(1, len(keys)) - 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = np.int64(size - 1)
        self.keys, self.places = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.places[slot[todo]] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]], self.places[slot[put]] = keys[put], put
            todo = todo[~(free & first)]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.places[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = slot[todo]
            out[todo] = self.places[at]
            todo = todo[(self.places[at] >= 0) & (self.keys[at] != keys[todo])]
        return out


class Level:
    """The kept contexts of one depth (keys, ascending) and the counts of the bytes after them.

    codes: contexts with the next byte (oldest first, one big-endian number), ascending.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        codes = codes.astype(np.uint64)
        self.keys, self.rows = np.unique(codes >> np.uint64(8), return_inverse=True)
        self.byte, self.n = (codes & np.uint64(255)).astype(np.int64), counts

    def counts(self, lo: int, hi: int) -> np.ndarray:
        """Counts (hi - lo, 256) of the contexts lo .. hi - 1."""
        out = np.zeros((hi - lo, 256))
        a, b = np.searchsorted(self.rows, [lo, hi])
        out[self.rows[a:b] - lo, self.byte[a:b]] = self.n[a:b]
        return out


CHUNK = 2048


def _parents(levels: list[Level], k: int, depth: int) -> np.ndarray:
    """For each context of level k (`depth` bytes), the place of the one without its oldest byte in level k - 1."""
    return np.searchsorted(levels[k - 1].keys, levels[k].keys & np.uint64((1 << 8 * (depth - 1)) - 1))


def climb(levels: list[Level], depth: int, below: np.ndarray | None = None, below_counts: np.ndarray | None = None) -> tuple[list[np.ndarray | None], np.ndarray, np.ndarray]:
    """Up from the deepest of consecutive levels, the first of `depth` bytes: the share that each node's own estimate has, by
    level (None at the tree's deepest), and the first level's weighted log probabilities and counts.

    below, below_counts: the sums of these over the children of the last level's contexts; None if it is the tree's deepest.
    """
    shares: list[np.ndarray | None] = [None] * len(levels)
    for k in range(len(levels) - 1, -1, -1):
        size = len(levels[k].keys)
        weighted, counts = np.empty((size, 255)), np.empty((size, 256))
        inner = below is not None
        if inner:
            shares[k] = np.empty((size, 255), np.float32)
        for lo in range(0, size, CHUNK):
            hi = min(size, lo + CHUNK)
            c = levels[k].counts(lo, hi)
            kt = log_kt(*bit_nodes(c))
            if inner:
                rest = log_kt(*bit_nodes(np.maximum(c - below_counts[lo:hi], 0)))
                weighted[lo:hi] = np.logaddexp(kt, below[lo:hi] + rest) - np.log(2)
                shares[k][lo:hi] = np.exp(np.minimum(0, kt - np.log(2) - weighted[lo:hi]))
            else:
                weighted[lo:hi] = kt
            counts[lo:hi] = c
        if k:
            up = _parents(levels, k, depth + k)
            order = np.argsort(up, kind="stable")
            groups, first = np.unique(up[order], return_index=True)
            above = len(levels[k - 1].keys)
            below, below_counts = np.zeros((above, 255)), np.zeros((above, 256))
            below[groups], below_counts[groups] = np.add.reduceat(weighted[order], first), np.add.reduceat(counts[order], first)
    return shares, weighted, counts


def descend(levels: list[Level], shares: list[np.ndarray | None], depth: int, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, tuple]]:
    """Down the levels: (k, log10 probabilities of level k's contexts (n, 256), state). state, or `above` for the first level:
    what all ancestors say, what weight they leave, and the last one's probability, for each context (of its parent in `above`)."""
    for k, level in enumerate(levels):
        size = len(level.keys)
        table = np.empty((size, 256), np.float32)
        state = tuple(np.empty((size, 255), np.float32) for _ in range(3))
        up = _parents(levels, k, depth + k) if k else np.arange(size)
        for lo in range(0, size, CHUNK):
            hi = min(size, lo + CHUNK)
            zeros, ones = bit_nodes(level.counts(lo, hi))
            own = (ones + 0.5) / (zeros + ones + 1)
            a0, l0, f0 = (x[up[lo:hi]] for x in above) if above else (np.zeros_like(own), np.ones_like(own), np.full_like(own, 0.5))
            w = shares[k][lo:hi] if shares[k] is not None else np.ones_like(own)
            some = zeros + ones > 0
            a, rest = np.where(some, a0 + l0 * w * own, a0), np.where(some, l0 * (1 - w), l0)
            final = np.clip(np.where(some, a + rest * own, f0), 1e-9, 1 - 1e-9)
            table[lo:hi] = byte_log10(final)
            for x, new in zip(state, (a, rest, final), strict=True):
                x[lo:hi] = new
        yield k, table, state
        above = state


class Lookup:
    """Rows of log10 probabilities by context, for scoring."""

    def __init__(self, depths: np.ndarray, contexts: np.ndarray, table: np.ndarray, depth: int):
        self.depth, self.table = depth, table
        self.places = Places(marked(depths, contexts))
        self.root = int(np.flatnonzero(depths == 0)[0])

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last byte after the `depth` bytes before it: the row of the longest kept context."""
        before = codes >> np.uint64(8)
        rows, todo = np.full(len(codes), self.root, np.int32), np.arange(len(codes))
        for d in range(self.depth, 0, -1):
            at = self.places.find(marked(d, before if d == self.depth else before[todo]))
            hit = at >= 0
            rows[todo[hit]] = at[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return self.table[rows, (codes & np.uint64(255)).astype(np.int64)]


def marked(depths: int | np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Contexts of all depths as distinct keys: a one above the bytes."""
    bit = np.uint64(1) << (np.uint64(8) * np.asarray(depths, np.uint64))
    return contexts.astype(np.uint64) & (bit - np.uint64(1)) | bit


class ContextTree(Lookup):
    """A whole tree. levels[d]: codes of d context bytes and the next one, ascending, with their counts, for the kept contexts
    of d bytes; the suffixes of a kept context must be kept."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        held = [Level(codes, counts) for codes, counts in levels]
        if not len(held[0].keys):  # no training data: the root alone, with no counts
            held[0].keys = np.zeros(1, np.uint64)
        shares, _, _ = climb(held, 0)
        tables = [table for _, table, _ in descend(held, shares, 0)]
        depths = np.repeat(np.arange(len(held)), [len(x.keys) for x in held])
        super().__init__(depths, np.concatenate([x.keys for x in held]), np.concatenate(tables), len(held) - 1)
