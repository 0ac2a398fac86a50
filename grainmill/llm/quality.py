"""Operator 5: quality rules from gradient-boosted trees over document statistics.

Statistics of the whole text are computed a block of documents at a time in numpy; the trees are fitted on the driver on
a bounded sample of labelled documents (`sample` of them, those of the least hash of id, label and text), flattened into
node arrays and broadcast. Nothing is shuffled: each task reads its documents, measures, scores and writes them.

A document is rejected if it fails the base rules (fewer than 20 words, or over 30 % of the words in 8-word windows that
repeat) or if the trees give it a probability of good quality below `threshold`. More symbols, repeated lines, repeated
windows and capitals never raise the probability (monotone constraints).

Nulls: a null text has no words and fails; a label without quality or doc_id is left out; without labels (or of one
class only) the base rules decide alone. A document with several labels takes part with each. Repeated rows get the same
verdict. An empty table gives an empty result. Input columns named like the output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .blocks import SPACE, Block, Spans, blocks, chain, words
from .common import without

#: Name and direction of each feature.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "stop_share": 0, "distinct_share": 0, "words_per_line": 0, "log_longest_word": 0, "bar_share": -1, "mark_share": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUT = (*BASE, "base_failed", "kept", "p_good")
WINDOW = 8
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b",;:!?\"'()[]{}", np.uint8))


def _again(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items occur twice or more in their document; which do not come first there."""
    key = hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def measure(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts (by name) and the features (documents x features) of a block."""
    data, offsets = block.data, block.offsets
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    spans = Spans(data)
    n_words = np.diff(first)
    doc_of = np.repeat(np.arange(n), n_words)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])

    inside = ~SPACE[data]
    points = inside & (data & 0xC0 != 0x80)
    hashes = spans.hash(starts, ends)
    windows = chain(hashes, WINDOW)
    valid = np.flatnonzero(doc_of[: len(windows)] == doc_of[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    twice, _ = _again(doc_of[valid], windows[valid])
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, valid[twice], 1)
    np.add.at(cover, valid[twice] + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    line_end = np.sort(np.concatenate((breaks, offsets[1:])))
    line_doc = np.sort(np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, "right") - 1)))
    filled = np.concatenate(([0], np.cumsum(inside)))
    some = filled[line_end] > filled[line_start]
    _, later = _again(line_doc[some], spans.hash(line_start[some], line_end[some]))
    n_lines = np.bincount(line_doc[some], minlength=n)
    base = {
        "n_words": n_words, "word_chars": per_doc(points), "n_symbols": per_doc(_SYMBOL[data]), "n_dup_lines": np.bincount(line_doc[some][later], minlength=n), "n_repeat_words": np.diff(covered[first]),
    }
    _, again = _again(doc_of, hashes)
    w, chars = np.maximum(n_words, 1), np.maximum(base["word_chars"], 1)
    longest = np.zeros(n)
    np.maximum.at(longest, doc_of, ends - starts)
    features = np.stack(
        [
            np.log1p(n_words), base["word_chars"] / w, base["n_symbols"] / w, base["n_dup_lines"] / np.maximum(n_lines, 1), base["n_repeat_words"] / w, per_doc(_UPPER[data]) / chars,
            per_doc(_DIGIT[data]) / chars, per_doc(_STOP[data]) / w, 1 - np.bincount(doc_of[again], minlength=n) / w, n_words / np.maximum(n_lines, 1), np.log1p(longest), per_doc(data == 124) / w, per_doc(_MARK[data]) / w,
        ],
        1,
    )
    return base, features


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, place): the features, the label and the row's place in the order of the sample."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            _, x = measure(block)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([flat, *(batch.column(c).slice(block.lo, block.hi - block.lo) for c in ("y", "place"))], ["x", "y", "place"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> boosting.Forest | None:
    """The trees, fitted on at most `sample` labelled documents; None if the labels show one class or none."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    ids = spark.createDataFrame(chosen.toArrow())  # `sample` rows at most
    joined = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y", F.xxhash64("doc_id", "y", "text").alias("place"))
    got = joined.mapInArrow(_features, "x array<double>, y double, place long").orderBy("place").limit(sample).toArrow()  # ids may repeat in docs
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T[::-1], y))  # the same trees whatever order the rows came in
    return boosting.fit(x[order], y[order], np.array(list(FEATURES.values())))


def _judge(batches: Iterator[pa.RecordBatch], forest: boosting.Forest | None, threshold: float, keep: list[str], only_kept: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            base, x = measure(block)
            p = 1 / (1 + np.exp(-forest.score(x))) if forest else np.ones(len(x))
            failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
            kept = ~failed & (p >= threshold)
            rows = batch.slice(block.lo, block.hi - block.lo)
            columns = [rows.column(c) for c in keep]
            if only_kept:
                out = pa.RecordBatch.from_arrays(columns, keep).filter(pa.array(kept))
            else:
                columns += [pa.array(base[c].astype(np.int64)) for c in BASE] + [pa.array(failed), pa.array(kept), pa.array(p)]
                out = pa.RecordBatch.from_arrays(columns, [*keep, *OUT])
            yield out


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000, digest: bool = True, only_kept: bool = False) -> DataFrame:
    """docs with the base counts, base_failed, kept and p_good; or, with only_kept, just the kept documents as they are.

    digest=True keeps doc_id alone of the input's columns.
    """
    docs = docs if only_kept else without(docs, *OUT)
    forest = fit_quality(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    keep = ["doc_id"] if digest and not only_kept else docs.columns
    schema = T.StructType([docs.schema[c] for c in keep])
    if not only_kept:
        for c in OUT:
            schema = schema.add(c, T.LongType() if c in BASE else T.DoubleType() if c == "p_good" else T.BooleanType())
    source = docs.select("doc_id", "text") if digest and not only_kept else docs
    return source.mapInArrow(lambda it: _judge(it, shared.value, threshold, keep, only_kept), schema)
