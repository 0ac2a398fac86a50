"""Operator 8: exact removal of repeated byte strings by the interval trees of enhanced suffix arrays.

A suffix array of the whole corpus would have to be sorted through one shuffle of a hundred times the text. So the
suffixes are dealt into groups first: a string of `length` bytes is represented by its anchor (see repeats.py), equal
strings have equal anchors, and only anchors that occur more than once matter. Each of their occurrences brings the
segment of text that its strings cover. A task builds the enhanced suffix array of its groups' segments, scans the
tree of common-prefix intervals and gets the maximal repeats with all their places (suffix_tree.py); in each, all places
but the earliest lose their bytes. Equal segments of one anchor enter the array once, with the earliest document.

An anchor of more than 256 occurrences is dealt over salts of about 256. Within a salt the array settles all but the
earliest place of each string; what is left meets by the hash of its `length`-byte strings in an aggregation with a
combiner. Repeats of a whole segment inside a document are found by the task that holds it.

Anchors and segments are compared by 64-bit hashes, strings under one anchor byte by byte. Nulls: a null text is empty; a
null doc_id comes before all others. Rows of one id with different texts are different documents in the order of their
text's hash; equal rows are the same document and don't remove each other. An empty table gives an empty result. Input
columns other than doc_id and text are ignored. Cuts may split a character, so kept bytes are returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, Spans, arrays, blocks, chain, signed
from .common import discard, materialize
from .repeats import anchors, first_of_owner, flat, lookup, merged_runs, packed, repeated_anchors, salt_of, unpacked, with_row_ids
from .suffix_tree import maximal_repeats

PART = 32
CHUNK = 1 << 19
PIECE = 1 << 26  # bytes of segments sent on together


def _anchored(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a block: hash, document, first and last start of its strings, and which come first of their kind in the document."""
    owner = np.repeat(np.arange(len(block.offsets) - 1), np.diff(block.offsets))
    parts = chain(block.data.astype(np.uint64) + np.uint64(1), PART)
    place, low, high = anchors(parts, owner, PART, length)
    h, doc = parts[place], owner[place] if len(place) else np.zeros(0, np.int64)
    segment = Spans(block.data).hash(low, high + length) if len(place) else np.zeros(0, np.uint64)
    return h, doc, low, high, first_of_owner(doc, h * np.uint64(0x9E3779B97F4A7C15) ^ segment)


def _first(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, __doc): the anchors of each document, one for each kind of segment."""
    for batch in batches:
        ids = batch.column("__doc").to_numpy()
        for block in blocks(batch.column("text")):
            h, doc, _, _, once = _anchored(block, length)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[once])), pa.array(ids[block.lo + doc[once]])], ["h", "__doc"])


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From the texts and their repeated anchors: (h, n, __doc, at, segment)."""
    for batch in batches:
        ids = batch.column("__doc").to_numpy()
        for block in unpacked(batch):
            h, doc, low, high, once = _anchored(block, length)
            hs, of = flat(batch.column("hs"), block.lo, block.hi)
            ns, _ = flat(batch.column("ns"), block.lo, block.hi)
            found = lookup(doc, h, of, hs.view(np.uint64))
            use = once & (found >= 0)
            h, doc, low, high, n = h[use], doc[use], low[use], high[use], ns[found[use]]
            sizes = high + length - low
            edges = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE, prepend=-1)) if len(h) else [0]  # a giant document's segments come piece by piece
            for lo, hi in zip(edges, [*edges[1:], len(h)], strict=True):
                first = np.concatenate(([0], np.cumsum(sizes[lo:hi])))
                text = block.data[np.repeat(low[lo:hi] - first[:-1], sizes[lo:hi]) + np.arange(first[-1])]
                segment = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(text)])
                columns = [pa.array(signed(h[lo:hi])), pa.array(n[lo:hi]), pa.array(ids[block.lo + doc[lo:hi]]), pa.array((low[lo:hi] - block.offsets[doc[lo:hi]]).astype(np.int32)), segment]
                yield pa.RecordBatch.from_arrays(columns, ["h", "n", "__doc", "at", "segment"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole (h, salt) groups of about CHUNK bytes, from rows in that order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.column("segment").nbytes for b in held) < CHUNK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h, salt = rows.column("h").to_numpy(), rows.column("salt").to_numpy()
        edge = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
        if not len(edge):
            held = [rows]
            continue
        lo = 0
        offsets = np.frombuffer(rows.column("segment").buffers()[1], np.int32)[rows.column("segment").offset :][: rows.num_rows + 1].astype(np.int64)
        while lo < edge[-1]:
            fits = edge[(edge > lo) & (offsets[edge] - offsets[lo] <= CHUNK)]
            hi = int(fits[-1]) if len(fits) else int(edge[edge > lo][0])
            yield rows.slice(lo, hi - lo)
            lo = hi
        held = [rows.slice(lo)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """kind 0: (__doc, at, stop), bytes that go; kind 1, for salted groups: (w, __doc, at), strings that are the earliest of their salt."""
    for rows in _grouped(batches):
        block = next(blocks(rows.column("segment"), 1 << 62))
        h, salt, doc, at = (rows.column(c).to_numpy() for c in ("h", "salt", "__doc", "at"))
        group = np.concatenate(([0], np.cumsum((h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))))
        spans = Spans(block.data)
        same = spans.hash(block.offsets[:-1], block.offsets[1:])
        order = np.lexsort((at, doc, same, group))
        lead = np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (same[order][1:] != same[order][:-1])))
        leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        copies = order[(doc[order] != doc[leader]) | (at[order] != at[leader])]  # equal rows bring a place twice
        size = np.diff(block.offsets)
        out = [(doc[copies], at[copies].astype(np.int64), at[copies] + size[copies])]
        leads = np.sort(order[lead])
        alone = np.bincount(group[leads])[group[leads]] == 1
        several = leads[~alone]
        firsts: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
        settled = np.zeros(len(block.data) + 1, np.int64)
        if len(several):
            sizes = size[several]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            data = block.data[np.repeat(block.offsets[several] - offsets[:-1], sizes) + np.arange(offsets[-1])]
            places, first, lengths = maximal_repeats(data, offsets, length)
            if len(places):
                of = np.searchsorted(offsets, places, "right") - 1
                row = several[of]
                within = places - offsets[of]
                node = np.repeat(np.arange(len(lengths)), np.diff(first))
                rank = np.lexsort((at[row] + within, doc[row], node))
                goes = np.ones(len(places), bool)
                goes[rank[first[:-1]]] = False
                row, within, span = row[goes], within[goes], lengths[node][goes]
                lo = block.offsets[row] + within
                run_lo, run_hi = merged_runs(lo * 2, (lo + span) * 2 - 1)  # touching runs of two segments stay apart
                run_lo, run_hi = run_lo // 2, (run_hi + 1) // 2
                owner = np.searchsorted(block.offsets, run_lo, "right") - 1
                shift = at[owner] - block.offsets[owner]
                out.append((doc[owner], run_lo + shift, run_hi + shift))
                np.add.at(settled, lo, 1)
                np.add.at(settled, lo + span - length + 1, -1)
        salted = leads[salt[leads] > 0]
        if len(salted):
            counts = size[salted] - length + 1
            base = np.concatenate(([0], np.cumsum(counts)))
            start = np.repeat(block.offsets[salted] - base[:-1], counts) + np.arange(base[-1])
            start = start[np.cumsum(settled)[start] == 0]
            owner = np.searchsorted(block.offsets, start, "right") - 1
            firsts = (signed(spans.hash(start, start + length)), doc[owner], start - block.offsets[owner] + at[owner])
        n0, n1 = sum(len(x[0]) for x in out), len(firsts[0])
        columns = [
            pa.array(np.repeat([0, 1], [n0, n1]).astype(np.int32)), pa.array(np.concatenate((np.zeros(n0, np.int64), firsts[0]))),
            pa.array(np.concatenate([x[0] for x in out] + [firsts[1]])), pa.array(np.concatenate([x[1] for x in out] + [firsts[2]]).astype(np.int64)),
            pa.array(np.concatenate([x[2] for x in out] + [firsts[2] + length]).astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "w", "__doc", "at", "stop"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in unpacked(batch):
            _, doc, low, high, once = _anchored(block, length)
            again = np.flatnonzero(~once)
            ats, of = flat(batch.column("ats"), block.lo, block.hi)
            stops, _ = flat(batch.column("stops"), block.lo, block.hi)
            owner = np.concatenate((doc[again], of)).astype(np.int64)
            lo = np.concatenate((low[again] - block.offsets[doc[again]], ats)).astype(np.int64)
            hi = np.concatenate((high[again] + length - block.offsets[doc[again]], stops)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            owner, lo, hi = owner[order], lo[order], hi[order]
            bounds = np.searchsorted(owner, np.arange(block.hi - block.lo + 1))
            removed, n_runs, digests, kept, runs = [], [], [], [], []
            for i in range(block.hi - block.lo):
                raw = block.text(i)
                a, b = merged_runs(lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]])
                if len(a):
                    edges = [0, *np.stack((a, b), 1).ravel().tolist(), len(raw)]
                    stay = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                else:
                    stay = raw
                removed.append(len(raw) - len(stay))
                n_runs.append(len(a))
                digests.append(hashlib.sha256(stay).hexdigest())
                if texts:
                    kept.append(stay)
                    runs.append(np.stack((a, b), 1).ravel())
            rows = batch.slice(block.lo, block.hi - block.lo)
            columns = [rows.column("doc_id"), pa.array(np.diff(block.offsets)), pa.array(removed, pa.int64()), pa.array(n_runs, pa.int64()), pa.array(digests, pa.string())]
            if texts:
                columns += [pa.array(kept, pa.binary()), arrays(np.concatenate(runs), np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "removed"][: len(columns)])


def remove_repeats(docs: DataFrame, length: int = 100, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept_bytes and removed (start and end of each removed run, one after the other)."""
    if length <= PART:
        raise ValueError(f"strings must be longer than {PART} bytes")
    docs = with_row_ids(docs)
    found = docs.select("__doc", "text").mapInArrow(lambda it: _first(it, length), "h long, __doc long")  # computed twice: written down it would be as large as the input
    repeated = materialize(repeated_anchors(found), "repeated")
    per_doc = repeated.groupBy("__doc").agg(F.collect_list("h").alias("hs"), F.collect_list("n").alias("ns"))
    segments = packed(docs).join(per_doc, "__doc").mapInArrow(lambda it: _segments(it, length), "h long, n long, __doc long, at int, segment binary")
    dealt = segments.withColumn("salt", salt_of(F.col("n"), "__doc")).drop("n").repartition("h", "salt").sortWithinPartitions("h", "salt")
    told = materialize(dealt.mapInArrow(lambda it: _repeats(it, length), "kind int, w long, __doc long, at long, stop long"), "repeats")
    discard(repeated)
    firsts = told.where("kind = 1")
    least = firsts.groupBy("w").agg(F.min("__doc").alias("least"))
    across = firsts.join(least, "w").where(F.col("least") < F.col("__doc"))
    gone = told.where("kind = 0").select("__doc", "at", "stop").unionByName(across.select("__doc", "at", "stop"))
    per_doc = gone.groupBy("__doc").agg(F.collect_list("at").alias("ats"), F.collect_list("stop").alias("stops"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary, removed array<long>" * texts
    return packed(docs).join(per_doc, "__doc", "left").mapInArrow(lambda it: _cut(it, length, texts), schema)


def removed_sql(length: int = 100) -> str:
    """The counts and digests of remove_repeats() in DuckDB's SQL, over all strings."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      p AS (SELECT doc_id, unnest(range(0, len(h) // 2 - {length - 1})) AS pos, h FROM d WHERE len(h) >= {2 * length}),
      k AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, {2 * length})) AS key FROM p),
      late AS (SELECT doc_id, pos FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1),
      edge AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM late),
      run AS (SELECT doc_id, pos, sum((before IS NULL OR pos > before + {length})::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edge),
      span AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + {length} AS hi FROM run GROUP BY ALL),
      kept AS (SELECT doc_id, lo, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS start, hi FROM span),
      parts AS (SELECT k.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (lo - start)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS rest, sum(hi - lo) AS gone, count(*) AS n FROM kept k JOIN d USING (doc_id) GROUP BY k.doc_id)
      SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN parts USING (doc_id)"""
