"""Texts of an Arrow batch as bytes in numpy: blocks of whole documents, words, hashes of spans.

Everything works on UTF-8 bytes. Words are runs of bytes other than space and \\t \\n \\v \\f \\r, which are ASCII, so
no character is ever split. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Block:
    """Rows lo .. hi - 1 of a batch; document i is data[offsets[i]:offsets[i + 1]]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


#: Bytes of a block: numbers of 8 bytes for each fit the processor's cache.
BLOCK = 1 << 17


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Whole documents together up to `limit` bytes; a longer document is a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return
    _, off, values = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document (and the end) its first word's number."""
    inside = ~SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    begin[edge[edge < len(data)]] = inside[edge[edge < len(data)]]
    end[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        base = int(_BASE[which])
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if n <= 1 << 24:  # those of a giant document are not kept
            _POWERS[which] = have
    return have


class Spans:
    """64-bit hashes of any spans of a block, from a polynomial prefix sum. `which` picks one of two independent bases."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chain(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of the n consecutive items from each place on; len(hashes) - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(hashes) + 1, which)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1] + np.uint64(n))


def tally(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs (or the sum of its counts)."""
    if counts is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, counts = values[order], counts[order]
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(counts, first) if counts is not None else np.diff(np.append(first, len(values)))


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return values.view(np.int64)


def arrays(flat: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i holds flat[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat, kind))
