"""Operator 2: context-tree weighting as a language model, beside a word-unigram base.

Both score the same thing: the text lower-cased (A-Z) as its words, one space after each, and one newline as its end; so
white space and case cost neither anything. The documents whose crc32(id) mod 7 is not 2 train, all are scored.

The n-grams of `depth` + 1 bytes and the words are counted over all texts, combined in each task before they are shuffled;
those of held-out documents count 0. The tree keeps every context seen at least `least` times, so it grows with the
text; what rarer ones saw enters the context one byte shorter. It is fitted in groups of the contexts that end in the same
two bytes, each a subtree: up, over the two levels above on the driver (257 contexts), and down again, where each distinct
n-gram of the group gets its probability. So the model comes out as a table of distinct n-grams, 12 bytes each, and no
more of the tree than a group's is ever held.

For scoring that table is dealt into shards of about `per_shard` n-grams, sorted and broadcast one by one. A task gathers
the n-grams of ROUND bytes of text, sorts them and loads one shard after the other, holding one at a time. A table of
more than `broadcast_grams` is joined by shuffling the documents' n-grams instead. The base needs every word's count: the
`common` most frequent words are broadcast (16 bytes each), the others are joined by shuffling their occurrences only.

Words are known by 64-bit hashes. Nulls: a null text is an empty one (its end alone); a null id counts as 'null' for the
split. Repeated rows each train and each get a row. Without training rows all probabilities come from empty counts. An
empty table gives an empty result. Input columns other than doc_id and text are ignored. A document is scored whole in one
task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, SPACE, Block, Spans, arrays, blocks, signed, tally, words
from .common import id_text, materialize
from .context_tree import Level, Places, climb, descend

END = np.uint64(0)  # the end's hash; a word's is never 0 but by chance of 2**-64
ROUND = 4 << 20  # bytes of text scored together, against one shard of the tree after the other
FLUSH = 2_000_000  # distinct n-grams or words held by a task before they are sent on


def split(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The documents as modelled (words, a space after each, a newline), their offsets; hashes of tokens, offsets."""
    low = LOWER[block.data]
    starts, ends, first = words(low, block.offsets)
    hashes = Spans(low).hash(starts, ends)
    n_docs = len(block.offsets) - 1
    tokens = np.insert(hashes, first[1:], END)
    token_first = first + np.arange(n_docs + 1)
    lengths = np.concatenate(([0], np.cumsum(ends - starts)))
    out_first = lengths[first] + first + np.arange(n_docs + 1)  # characters, a space a word, a newline a document
    out = np.full(int(out_first[-1]), 32, np.uint8)
    inside = ~SPACE[low]
    doc_of = np.repeat(np.arange(n_docs), np.diff(first))
    shift = np.arange(len(starts)) + doc_of + lengths[:-1] - starts
    out[np.flatnonzero(inside) + np.repeat(shift, ends - starts)] = low[inside]
    out[out_first[1:] - 1] = 10
    return out, out_first, tokens, token_first


def grams(data: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """For every byte, it and the `depth` bytes before it as one number; before a document stand newlines."""
    code = data.astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first))
    out = code.copy()
    for k in range(1, depth + 1):
        before = np.full(len(data), 10, np.uint64)
        before[k:] = code[:-k]
        before[at < k] = 10
        out |= before << np.uint64(8 * k)
    return out


def _sums(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): kind 0 for words, 1 for n-grams."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
        if len(held[kind]) == 1:
            return held[kind][0]
        return tally(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))

    def out(kind: int) -> Iterator[pa.RecordBatch]:
        keys, n = merged(kind)
        for lo in range(0, len(keys), 100_000):
            k = keys[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(signed(k)), pa.array(n[lo : lo + 100_000].astype(np.int64))], ["kind", "key", "n"])

    for whole in batches:
        for held_out in (False, True):
            batch = whole.filter(pc.equal(whole.column("held_out"), held_out))
            for block in blocks(batch.column("text"), 1 << 20):
                data, first, tokens, _ = split(block)
                for kind, (keys, n) in enumerate((tally(tokens), tally(grams(data, first, depth)))):
                    if held_out and not kind:
                        continue
                    held[kind].append((keys, n * (not held_out)))
                    if len(held[kind]) >= 16:
                        held[kind] = [merged(kind)]
                    if len(held[kind]) == 1 and len(held[kind][0][0]) > FLUSH:
                        yield from out(kind)
                        held[kind] = []
    for kind in (0, 1):
        if held[kind]:
            yield from out(kind)


def train_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): words by hash (0) and byte n-grams by code (1) with their occurrences in the training documents; n-grams of held-out ones alone with 0."""
    sums = docs.select("text", "held_out").mapInArrow(lambda it: _sums(it, depth), "kind int, key long, n long")
    return materialize(sums.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts: as many whole steps of a histogram of the counts (8 to a doubling) as make `most` rows or fewer."""
    step = F.floor(F.log2(count) * 8).cast("int")
    taken, least = 0, None
    for row in rows.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 512 rows
        taken += row["count"]
        if taken > most:
            break
        least = row["step"]
    return rows.where(step >= least) if least is not None else rows.where(F.lit(False))


def contexts_of(counts: DataFrame, depth: int, least: int) -> DataFrame:
    """(d, context, codes, ns): the contexts of 0 to `depth` bytes seen `least` times (those of one byte or none all), with the counts after them."""
    each = [F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("code")) for d in range(depth + 1)]
    levels = counts.where("kind = 1 AND n > 0").select(F.explode(F.array(*each)).alias("x"), "n").groupBy("x.d", "x.code").agg(F.sum("n").alias("n"))
    found = levels.groupBy("d", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("seen"), F.collect_list(F.struct("code", "n")).alias("x"))
    kept = found.where((F.col("d") < TOP) | (F.col("seen") >= least))
    return materialize(kept.select("d", "context", F.col("x.code").alias("codes"), F.col("x.n").alias("ns")), "contexts")


#: Bytes that the contexts of a group end in.
TOP = 2


def _levels(rows: pa.Table, first: int, depth: int) -> list[Level]:
    """The levels of the rows (d, codes, ns), from `first` to `depth` bytes."""
    d = np.repeat(rows.column("d").to_numpy(), pc.list_value_length(rows.column("codes")).to_numpy())
    codes, ns = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("codes", "ns"))
    order = np.lexsort((codes, d))
    d, codes, ns = d[order], codes[order], ns[order].astype(float)
    edge = np.searchsorted(d, np.arange(first, depth + 2))
    return [Level(codes[a:b], ns[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _blobs(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def probabilities(counts: DataFrame, depth: int, least: int) -> DataFrame:
    """(code, logp): log10 of the probability of the last byte of every distinct n-gram. Only the root's and the one-byte contexts' counts and the sums below these pass through the driver."""
    if not TOP <= depth <= 6:
        raise ValueError(f"depth must be {TOP} to 6")
    spark = counts.sparkSession
    contexts = contexts_of(counts, depth, least)
    groups = contexts.where(F.col("d") >= TOP).withColumn("suffix", F.col("context").bitwiseAND((1 << 8 * TOP) - 1))

    def up(rows: pa.Table) -> pa.Table:
        _, weighted, seen = climb(_levels(rows, TOP, depth), TOP)
        return pa.table({"parent": pa.array([rows.column("suffix")[0].as_py() & 255], pa.int64()), "below": _blobs(weighted), "seen": _blobs(seen)})

    def summed(rows: pa.Table) -> pa.Table:
        below, seen = (_matrix(rows.column(c), np.float64, w).sum(0, keepdims=True) for c, w in (("below", 255), ("seen", 256)))
        return pa.table({"parent": rows.column("parent").slice(0, 1), "below": _blobs(below), "seen": _blobs(seen)})

    shape = "parent long, below binary, seen binary"
    sums = groups.groupBy("suffix").applyInArrow(up, shape).groupBy("parent").applyInArrow(summed, shape).toArrow()  # 256 rows at most
    top = _levels(contexts.where(F.col("d") < TOP).select("d", "codes", "ns").toArrow(), 0, TOP - 1)  # 257 contexts at most
    if not len(top[0].keys):  # no training data: the root alone, with no counts
        top[0].keys = np.zeros(1, np.uint64)
    below, seen = np.zeros((len(top[1].keys), 255)), np.zeros((len(top[1].keys), 256))
    at = np.searchsorted(top[1].keys, sums.column("parent").to_numpy().astype(np.uint64))
    below[at], seen[at] = _matrix(sums.column("below"), np.float64, 255), _matrix(sums.column("seen"), np.float64, 256)
    shares, _, _ = climb(top, 0, below, seen)
    done = list(descend(top, shares, 0))
    handed = spark.sparkContext.broadcast((done[0][1], top[1].keys, done[1][1], done[1][2]))

    def down(kept: pa.Table, grams_: pa.Table) -> pa.Table:
        root, keys, table, state = handed.value
        codes = grams_.column("code").to_numpy().view(np.uint64)
        byte, before = (codes & np.uint64(255)).astype(np.int64), codes >> np.uint64(8)
        out = root[0, byte]

        def use(keys: np.ndarray, table: np.ndarray, d: int) -> None:
            if not len(keys):
                return
            context = before & np.uint64((1 << 8 * d) - 1)
            at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            hit = keys[at] == context
            out[hit] = table[at[hit], byte[hit]]

        use(keys, table, 1)
        if kept.num_rows:
            levels = _levels(kept, TOP, depth)
            shares, _, _ = climb(levels, TOP)
            above = np.searchsorted(keys, levels[0].keys & np.uint64(255))
            for k, rows, _ in descend(levels, shares, TOP, tuple(x[above] for x in state)):
                use(levels[k].keys, rows, TOP + k)
        return pa.table({"code": grams_.column("code"), "logp": pa.array(out.astype(np.float32))})

    every = counts.where("kind = 1").select(F.col("key").alias("code"), F.shiftright("key", 8).bitwiseAND((1 << 8 * TOP) - 1).alias("suffix"))
    return materialize(groups.groupBy("suffix").cogroup(every.groupBy("suffix")).applyInArrow(down, "code long, logp float"), "model")


def shards_of(model: DataFrame, per_shard: int, most: int) -> tuple[np.ndarray, list] | None:
    """The model as broadcast, sorted arrays (codes, logp), and the least code of each but the first; one shard in the driver's memory at a time. None if it has more than `most` n-grams."""
    n = model.count()
    if n > most:
        return None
    shards = max(1, -(-n // per_shard))
    bounds = sorted({int(x) for x in model.approxQuantile("code", [k / shards for k in range(1, shards)], 0.1 / shards)}) if shards > 1 else []
    out = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = model if low is None else model.where(F.col("code") >= low)
        rows = (part if high is None else part.where(F.col("code") < high)).toArrow()
        codes = rows.column("code").to_numpy().view(np.uint64)
        order = np.argsort(codes)
        out.append(model.sparkSession.sparkContext.broadcast((codes[order], rows.column("logp").to_numpy()[order])))
        del rows
    return np.array(bounds, np.uint64), out


def _looked_up(codes: np.ndarray, bounds: np.ndarray, shards: list) -> np.ndarray:
    """logp of each code, from one shard after the other."""
    distinct, back = np.unique(codes, return_inverse=True)
    edge = [0, *np.searchsorted(distinct, bounds).tolist(), len(distinct)]
    found = np.empty(len(distinct))
    for k, shard in enumerate(shards):
        keys, logp = shard.value
        found[edge[k] : edge[k + 1]] = logp[np.searchsorted(keys, distinct[edge[k] : edge[k + 1]])]
        if len(shards) > 1:
            del keys, logp
            shard.__dict__.pop("_value", None)  # loaded again from its file in the next round
    return found[back]


_OUT = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "score", "size", "codes"]


def _score(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, list] | None, depth: int, words_known: tuple[Places, np.ndarray], log_total: float) -> Iterator[pa.RecordBatch]:
    """Rows of _OUT; codes are the n-grams of those documents that are still to be joined with the model (None)."""
    places, known = words_known
    logs = np.log10(known + 1.0) - log_total
    held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]] = []

    def scored() -> Iterator[pa.RecordBatch]:
        score = _looked_up(np.concatenate([c for _, c, _ in held]), *model) if model else None
        lo = 0
        for columns, codes, first in held:
            size = pa.array(np.diff(first))
            if model:
                total = np.concatenate(([0.0], np.cumsum(score[lo : lo + len(codes)])))
                lo += len(codes)
                rest = [pa.array(np.diff(total[first])), size, arrays(np.zeros(0, np.int64), np.zeros(len(first), np.int64), pa.int64())]
            else:
                rest = [pa.array(np.zeros(len(first) - 1)), size, arrays(signed(codes), first, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *rest], _OUT)
        held.clear()

    size = 0
    for batch in batches:
        for block in blocks(batch.column("text")):
            data, first, tokens, token_first = split(block)
            at = places.find(tokens)
            common = at >= 0
            base = np.concatenate(([0.0], np.cumsum(np.where(common, logs[at] if len(logs) else 0.0, 0.0))))
            hits = np.concatenate(([0], np.cumsum(common)))
            rare_first = token_first - hits[token_first]
            columns = [batch.column(c).slice(block.lo, block.hi - block.lo) for c in ("row", "doc_id", "held_out")]
            columns += [pa.array(np.diff(token_first)), pa.array(np.diff(hits[token_first])), pa.array(np.diff(base[token_first])), arrays(signed(tokens[~common]), rare_first, pa.int64())]
            held.append((columns, grams(data, first, depth), first))
            size += len(data)
            if size >= ROUND:
                yield from scored()
                size = 0
    if held:
        yield from scored()


def score_documents(docs: DataFrame, depth: int = 5, least: int = 16, common: int = 262_144, per_shard: int = 4_000_000, broadcast_grams: int = 100_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte of what is modelled."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.crc32(id_text().cast("binary")) % 7 == 2).alias("held_out"))
    counts = train_counts(docs, depth)
    table = probabilities(counts, depth, least)
    model = shards_of(table, per_shard, broadcast_grams)
    vocabulary = counts.where("kind = 0").select("key", "n")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    log_total = float(np.log10(total + distinct + 1))
    head = most_frequent(vocabulary, "n", common).toArrow()  # `common` rows at most
    shared = spark.sparkContext.broadcast((Places(head.column("key").to_numpy().view(np.uint64)), head.column("n").to_numpy()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    shape = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, rare array<long>, score double, size long, codes array<long>"
    scored = materialize(rows.mapInArrow(lambda it: _score(it, model, depth, shared.value, log_total), shape), "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).join(vocabulary, "key", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0) - log_total).alias("rare_base"))
    out = scored.drop("rare", "codes").join(rare, "row", "left")
    if model is None:
        each = scored.select("row", F.explode("codes").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times"))
        sums = each.join(table, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("logp").cast("double")).alias("joined"))
        out = out.join(sums, "row", "left").withColumn("score", F.coalesce("joined", "score"))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score", (F.col("score") / (-np.log10(2.0) * F.col("size"))).alias("bits_per_byte"),
    )
