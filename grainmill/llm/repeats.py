"""What the two exact repeat removers share: row ids, sampled anchors, packed texts.

A window of `length` symbols is represented by its anchor: the sub-window of `part` symbols with the least hash in it,
the last one on ties. Equal windows have equal anchors at equal places, so a window can occur twice only if its anchor
does; of the anchors only about two in length - part + 2 positions exist. Each anchor stands for the run of windows
that share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK, Block, mix

_CODEC = "zstd"
#: Groups of more occurrences are dealt over salts of about this many.
SALT = 256


NULL_ID = -(1 << 63)


def most_repeats(docs: DataFrame) -> int:
    """How many rows the most frequent doc_id has."""
    return docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0


def with_row_ids(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, text, __doc), or all columns and __doc: a long for each document, in the order of doc_id; a null id comes first.

    Where ids repeat, rows of one id are numbered by their text's hash (equal texts alike), so that different texts are
    different documents; doc_id * repeats must then fit a long. Other types of doc_id than whole numbers are an error.
    """
    docs = docs if whole else docs.select("doc_id", "text")
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number: documents are ordered by it")
    most = most_repeats(docs)
    if most <= 1:
        return docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    texts = docs.select("doc_id", F.xxhash64("text").alias("__id_hash")).distinct()
    numbers = texts.withColumn("__id_number", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("__id_hash")) - 1)
    numbers = numbers.select(F.col("doc_id").alias("__id_same"), "__id_hash", "__id_number")
    joined = docs.withColumn("__id_text", F.xxhash64("text")).join(numbers, F.col("doc_id").eqNullSafe(F.col("__id_same")) & (F.col("__id_text") == F.col("__id_hash")))
    low = F.lit(NULL_ID // most + 1)
    return joined.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), low) * most + F.col("__id_number")).drop("__id_text", "__id_same", "__id_hash", "__id_number")


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, owner: np.ndarray, part: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of `length` symbols within one owner: their places, first and last window start.

    hashes: of the sub-windows of `part` symbols from each place on; owner: of each symbol, ascending.
    """
    windows = len(owner) - length + 1
    empty = np.zeros(0, np.int64)
    if windows <= 0:
        return empty, empty, empty
    width = length - part + 1
    reverse = np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64)
    least = _slide_min(hashes & np.uint64(0xFFFFFFFF00000000) | reverse, width)[:windows]
    starts = np.flatnonzero(owner[:windows] == owner[length - 1 :])
    place = (np.uint64(0xFFFFFFFF) - (least[starts] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    if not len(starts):
        return empty, empty, empty
    fresh = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(starts) != 1))))
    return place[fresh], starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1]


def merged_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as ascending, separate ones (touching ones become one)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return starts[fresh], ends[np.append(fresh[1:], len(starts)) - 1]


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, __doc, size, z): the texts compressed, for the two shuffles that bring them to their documents' findings."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer() if t.is_valid else pa.py_buffer(b"") for t in batch.column("text").cast(pa.binary())]
            z = pa.array([pa.compress(t, codec=_CODEC, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__doc"), pa.array([t.size for t in texts], pa.int64()), z], ["doc_id", "__doc", "size", "z"])

    return docs.select("doc_id", "__doc", "text").mapInArrow(pack, f"doc_id {kind}, __doc long, size long, z binary")


def unpacked(batch: pa.RecordBatch, limit: int = BLOCK) -> Iterator[Block]:
    """The packed texts of a batch as blocks."""
    sizes = batch.column("size").to_numpy()
    held: list[bytes] = []
    lo, total = 0, 0
    for i, z in enumerate(batch.column("z")):
        held.append(pa.decompress(z.as_buffer(), int(sizes[i]), codec=_CODEC, asbytes=True) if sizes[i] else b"")
        total += sizes[i]
        if total >= limit or i + 1 == len(sizes):
            yield Block(lo, i + 1, np.frombuffer(b"".join(held), np.uint8), np.concatenate(([0], np.cumsum(sizes[lo : i + 1]))))
            held, lo, total = [], i + 1, 0


def flat(lists: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of rows lo .. hi - 1 of a list column, and the row (from 0) of each; null rows have none."""
    part = lists.slice(lo, hi - lo)
    lengths = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
    return part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(hi - lo), lengths)


def lookup(owner: np.ndarray, keys: np.ndarray, in_owner: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each (owner, key), a place in (in_owner, wanted) where the same pair stands, or -1."""
    spread = np.uint64(0x9E3779B97F4A7C15)
    have = wanted ^ mix(in_owner.astype(np.uint64) * spread)
    order = np.argsort(have)
    if not len(order):
        return np.full(len(keys), -1)
    want = keys ^ mix(owner.astype(np.uint64) * spread)
    at = np.minimum(np.searchsorted(have[order], want), len(order) - 1)
    return np.where(have[order][at] == want, order[at], -1)


def first_of_owner(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which items come first among the equal keys of their owner."""
    key = keys ^ mix(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    out = np.ones(len(key), bool)
    out[order[1:]] = key[order][1:] != key[order][:-1]
    return out


def repeated_anchors(found: DataFrame) -> DataFrame:
    """Rows of found (h, __doc, ...) whose h occurs in two rows or more, with `n`, how many."""
    counts = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(counts, "h")


def salt_of(n: Column, doc: str | Column) -> Column:
    """0 for a small group; for one of n > SALT rows, one of about n / SALT numbers from 1 on."""
    return F.when(n > SALT, F.pmod(F.xxhash64(doc), F.ceil(n / SALT)) + 1).otherwise(F.lit(0)).cast("int")
