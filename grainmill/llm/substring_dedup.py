"""Operator 6: exact removal of repeated word windows, found by level-wise doubling.

A window can repeat only if the windows of half its length in it repeat. So the ladder begins with windows of `start`
words, counts them over all documents, extends those that are repeated to twice the length, counts these, and so on up
to `length`; it ends early where no candidate survives. On the rungs below `length` windows are sampled: each window of
the next rung by its anchor (see repeats.py), so that 2 / (words + 2) of them are counted and none of the next rung is
missed; at `length` itself every window under a repeated anchor is looked up. Windows still longer are covered by these
and remove nothing more. Each word covered by a window whose words also start earlier - in a smaller doc_id, or further
ahead in the same document - goes. A rung of few words brings more rows than it spares later ones: by default the
ladder has two, of half and of the whole length.

Repeats inside a document are found by the task that holds it; between documents only each one's first occurrence
counts, and what is looked up is the least document of each window. A window under an anchor of more than 256
occurrences is dealt over salts: within a salt all but its least document are settled, and the salts' least ones meet
in an aggregation with a combiner. Words are known by 64-bit hashes, windows by hashes of those.

Nulls: a null text has no words; a null doc_id comes before all others. Rows of one id with different texts are
different documents in the order of their text's hash; equal rows are the same document and don't remove each other. An
empty table gives an empty result. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Spans, arrays, blocks, chain, signed, words
from .common import WORD, discard, materialize
from .repeats import anchors, first_of_owner, flat, lookup, packed, repeated_anchors, salt_of, unpacked, with_row_ids


def _hashed(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and each word's document."""
    starts, ends, first = words(text, offsets)
    return Spans(text).hash(starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def _first_rung(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(h, __doc): the distinct sampled windows of `size` words of each document."""
    for batch in batches:
        ids = batch.column("__doc").to_numpy()
        for block in blocks(batch.column("text")):
            hashes, owner = _hashed(block.data, block.offsets)
            parts = chain(hashes, size)
            place, _, _ = anchors(parts, owner, size, 2 * size)
            h, doc = parts[place], owner[place]
            once = first_of_owner(doc, h)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[once])), pa.array(ids[block.lo + doc[once]])], ["h", "__doc"])


def _next_rung(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From the texts and their repeated windows of `size` words: (h, __doc), the sampled windows of twice as many that such a one stands for."""
    for batch in batches:
        ids = batch.column("__doc").to_numpy()
        for block in unpacked(batch):
            hashes, owner = _hashed(block.data, block.offsets)
            parts = chain(hashes, size)
            place, low, high = anchors(parts, owner, size, 2 * size)
            hs, of = flat(batch.column("hs"), block.lo, block.hi)
            kept = lookup(owner[place], parts[place], of, hs.view(np.uint64)) >= 0
            alive = np.zeros(len(owner) + 1, np.int64)  # windows of twice the length, by their starts
            np.add.at(alive, low[kept], 1)
            np.add.at(alive, high[kept] + 1, -1)
            alive = np.cumsum(alive) > 0
            longer = chain(hashes, 2 * size)
            place, _, _ = anchors(longer, owner, 2 * size, 4 * size)
            place = place[alive[place]]
            h, doc = longer[place], owner[place]
            once = first_of_owner(doc, h)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[once])), pa.array(ids[block.lo + doc[once]])], ["h", "__doc"])


def _extend(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From the texts and their repeated anchors: (w, __doc, at, n), each document's first occurrence of the full windows under such an anchor."""
    half = length // 2
    for batch in batches:
        ids = batch.column("__doc").to_numpy()
        for block in unpacked(batch):
            hashes, owner = _hashed(block.data, block.offsets)
            parts = chain(hashes, half)
            place, low, high = anchors(parts, owner, half, length)
            hs, of = flat(batch.column("hs"), block.lo, block.hi)
            ns, _ = flat(batch.column("ns"), block.lo, block.hi)
            found = lookup(owner[place], parts[place], of, hs.view(np.uint64))
            low, high, n = low[found >= 0], high[found >= 0], ns[found[found >= 0]]
            counts = high - low + 1
            starts = np.repeat(low - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(counts.sum())
            w = chain(hashes, length)[starts]
            once = first_of_owner(owner[starts], w)
            starts, w, n = starts[once], w[once], np.repeat(n, counts)[once]
            doc = owner[starts]
            at = starts - np.searchsorted(owner, doc)
            columns = [pa.array(signed(w)), pa.array(ids[block.lo + doc]), pa.array(at.astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["w", "__doc", "at", "n"])


def _settle(found: DataFrame) -> DataFrame:
    """(__doc, at) of the windows that a smaller document has too."""
    found = found.withColumn("salt", salt_of(F.col("n"), "__doc")).drop("n")
    least = found.withColumn("least", F.min("__doc").over(Window.partitionBy("w", "salt")))
    least = materialize(least.where((F.col("least") < F.col("__doc")) | (F.col("salt") > 0)), "windows")
    inside = least.where(F.col("least") < F.col("__doc")).select("__doc", "at")
    firsts = least.where((F.col("least") == F.col("__doc")) & (F.col("salt") > 0)).select("w", "__doc", "at")
    over = firsts.groupBy("w").agg(F.min("__doc").alias("least"))
    across = firsts.join(over, "w").where(F.col("least") < F.col("__doc")).select("__doc", "at")
    return inside.unionByName(across)


def _cut(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in unpacked(batch):
            starts, ends, first = words(block.data, block.offsets)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            windows = chain(Spans(block.data).hash(starts, ends), length)
            whole = np.flatnonzero(owner[: len(windows)] == owner[length - 1 :]) if len(windows) else np.zeros(0, np.int64)
            later = whole[~first_of_owner(owner[whole], windows[whole])]
            ats, of = flat(batch.column("ats"), block.lo, block.hi)
            edge = np.zeros(len(starts) + 1, np.int64)
            for at in (later, first[of] + ats.astype(np.int64)):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
            kept_words = ~gone
            digests, kept, runs = [], [], []
            for i in range(block.hi - block.lo):
                raw = block.text(i)
                mine = slice(first[i], first[i + 1])
                if removed[i]:
                    stay = kept_words[mine]
                    base = block.offsets[i]
                    text = b" ".join(raw[s:e] for s, e in zip((starts[mine][stay] - base).tolist(), (ends[mine][stay] - base).tolist(), strict=True))
                else:
                    text = b" ".join(raw.split())
                digests.append(hashlib.sha256(text).hexdigest())
                if texts:
                    kept.append(text)
                    turn = np.diff(np.concatenate(([False], gone[mine], [False])).astype(np.int8))
                    runs.append(np.flatnonzero(turn))
            rows = batch.slice(block.lo, block.hi - block.lo)
            columns = [rows.column("doc_id"), pa.array(np.diff(first)), pa.array(removed), pa.array(digests, pa.string())]
            if texts:
                columns += [pa.array(kept, pa.binary()).cast(pa.string()), arrays(np.concatenate(runs), np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"][: len(columns)])


def remove_repeats(docs: DataFrame, length: int = 20, start: int | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept_text and removed (first word and end of each removed run, one after the other).

    start: words of the ladder's first rung, length / 2 by default; length must be twice, four times, ... that.
    """
    size = start or length // 2
    rungs = [size * 2**k for k in range(length.bit_length())]
    if size < 2 or length not in rungs[1:]:
        raise ValueError("the window must have twice, four times, ... the words of the first rung, and that 2 or more")
    docs = with_row_ids(docs)
    found = docs.select("__doc", "text").mapInArrow(lambda it: _first_rung(it, rungs[0]), "h long, __doc long")
    for k in range(rungs.index(length)):
        repeated = materialize(repeated_anchors(found), "rung")
        if k:
            discard(spent)
        spent = repeated
        per_doc = repeated.groupBy("__doc").agg(F.collect_list("h").alias("hs"), F.collect_list("n").alias("ns"))
        if rungs[k + 1] == length or not repeated.limit(1).count():
            break
        found = packed(docs).join(per_doc, "__doc").mapInArrow(lambda it, size=rungs[k]: _next_rung(it, size), "h long, __doc long")
    candidates = packed(docs).join(per_doc, "__doc").mapInArrow(lambda it: _extend(it, length), "w long, __doc long, at int, n long")
    gone = _settle(candidates).groupBy("__doc").agg(F.collect_list("at").alias("ats"))
    discard(spent)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<long>" * texts
    return packed(docs).join(gone, "__doc", "left").mapInArrow(lambda it: _cut(it, length, texts), schema)


def removed_sql(length: int = 20) -> str:
    """The counts and digests of remove_repeats() in DuckDB's SQL."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
      k AS (SELECT doc_id, list_transform(range(len(w) - {length - 1}), lambda i: md5(array_to_string(w[i + 1:i + {length}], ' '))) AS ks FROM d WHERE len(w) >= {length}),
      p AS (SELECT doc_id, unnest(ks) AS key, unnest(range(len(ks))) AS pos FROM k),
      late AS (SELECT doc_id, pos FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1),
      gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {length})) AS i FROM late),
      words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
      kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
      SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
