"""Operator 3: benchmark decontamination by spaced-seed hashing, in built-in functions only.

Tokens are the runs of letters and digits of the lower-cased text, hashed to 64 bits. A seed is a fixed mask over a span
of tokens; it hashes the tokens under its ones and ignores those under its zeros, so a passage with a token replaced
still meets the benchmark wherever the change falls on a zero of one of the masks. Every token position of every
document is hashed under every mask and joined to the benchmark's hashes. Around each hit the two texts are laid side by
side without gaps, `reach` tokens beyond the seed on both sides, clipped to the item and the document. The hit is
confirmed if in any window of these that holds the seed and `least` tokens or more (the whole of a shorter item) at least
`similarity` of the tokens agree. Windows of up to 2 * least - 1 tokens do: of the halves of a longer one, one agrees as well.

The documents are not shuffled to be searched: exploding, hashing, probing and confirming run in one stage. Both sides
are cut into pieces of PIECE tokens with margins in which every window of one of its seeds lies, so that what a hit
carries doesn't grow with the texts. The hash table of the benchmark is broadcast if its counted rows are at most
`broadcast_rows`; a larger one is joined by shuffling the hashes, and only the pieces of distinct hits get their tokens
again (for that the pieces of all documents are shuffled).

Texts that repeat themselves (zeros, separators, the rows of a table) would meet an equally repetitive item once for each
pair of places. A seed is left out if all tokens that a window around it can hold stand the same way 1 to PERIODS places
earlier: what it would find the earlier one finds as well, so nothing is lost, and of a run of any length only its
beginning and its end are sought.

With the masks COVER and a similarity of 0.8 nothing that the windows would confirm is missed by the seeds. Longer masks
meet fewer stray hits but leave out patterns; items shorter than their span are then sought by a contiguous seed.

Nulls: a null text (either side) has no tokens and meets nothing; a null doc_id is a document of its own text. Items of
fewer than SHORT_SPAN tokens are no evidence and meet nothing. Repeated rows get the same verdict. Empty tables give clean
documents or an empty result. Input columns named like the output are replaced; all others stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused, without

#: Masks that find five tokens laid side by side with none or one of them replaced, whichever it is (the first at either
#: end). A window of n tokens with n / 5 replaced or fewer, n 5 or more, holds such five: of its n / 5 blocks one has at most one.
COVER = ("1111", "11011", "10111", "11101")
#: The masks of leaks_sql() over 13 tokens: 8 count, 5 are ignored; the first is mostly contiguous, the others spread.
MASKS = ("1111011100001", "1101100101011", "1010111001101", "1110010110011")
SHORT_SPAN = 5
#: Tokens whose seeds a piece holds, and the periods of repetition that are sought only at their edges.
PIECE, PERIODS = 128, 4
OUT = ("contaminated", "n_items", "item_id", "matched")


def token_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _pieces(rows: DataFrame, keep: list[str], h: str, context: int) -> DataFrame:
    """Rows of PIECE places of the array h: keep, piece, c (their tokens and `context` more on both sides) and places, those of
    c that are to be sought."""
    n = F.size(h)

    def cut(k: Column) -> Column:
        low = k * PIECE
        start = F.greatest(F.lit(0), low - context - PERIODS)
        end = F.least(n, low + PIECE + context + 1)
        return F.struct(k.alias("piece"), F.slice(h, start + 1, end - start).alias("c"), (low - start).alias("first"))

    def alike(i: Column, k: int) -> Column:
        return F.get("c", i) == F.get("c", i - k)

    def again(p: Column, k: int) -> Column:
        around = F.forall(F.sequence(F.lit(-context), F.lit(context)), lambda o: alike(p + o, k))
        return (p >= context + k) & (p + context < F.size("c")) & alike(p, k) & around

    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))  # a filter or an inner explode would compute h or the pieces twice
    pieces = rows.select(*keep, F.inline_outer(F.transform(numbers, cut)))
    places = F.sequence(F.col("first"), F.least(F.col("first") + PIECE, F.size("c")) - 1)
    periods = range(1, PERIODS + 1)
    fresh = F.filter(places, lambda p: ~reduce(Column.__or__, [F.coalesce(again(p, k), F.lit(False)) for k in periods]))
    steps = range(context, PIECE + 2 * context + PERIODS, context)  # 2 * context + 1 places that are alike hold one of these and the next
    some = reduce(Column.__or__, [F.coalesce(alike(F.lit(x), k) & alike(F.lit(x + 1), k), F.lit(False)) for x in steps for k in periods])
    return pieces.select(*keep, "piece", "c", F.when(some, fresh).otherwise(places).alias("places"))


def _seeds(c: Column, p: Column, masks: tuple[str, ...]) -> Column:
    """For place p of the tokens c (0-based): an array of seeds by mask, null where the span leaves the text."""
    one = []
    for k, mask in enumerate(masks):
        picked = [F.get(c, p + o) for o, bit in enumerate(mask) if bit == "1"]
        one.append(F.when(p + len(mask) <= F.size(c), F.xxhash64(F.lit(k), *picked)))
    return F.array(*one)


def _best(h: Column, at: Column, item: Column, low: Column, high: Column, seed: Column, end: Column, need: Column, most: int, similarity: float) -> Column:
    """The most agreeing tokens in a window of the item's tokens low .. high - 1, laid on the document from `at`, that holds
    the seed's tokens seed .. end - 1, has `need` to `most` tokens and agrees in `similarity` of them; 0 if there is none."""
    same = F.transform(F.sequence(low, high - 1), lambda j: F.coalesce((F.get(h, at + j) == F.get(item, j)).cast("int"), F.lit(0)))
    sums = F.aggregate(same, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def widest(p: Column) -> Column:
        def to(i: Column) -> Column:
            size, agree = (lambda j: j - i), (lambda j: F.get(p, j) - F.get(p, i))
            good = lambda j: (size(j) >= need) & (size(j) <= most) & (agree(j) >= similarity * size(j))
            return F.aggregate(F.sequence(end - low, high - low), F.lit(0), lambda acc, j: F.when(good(j), F.greatest(acc, agree(j))).otherwise(acc))

        windows = F.aggregate(F.sequence(F.lit(0), seed - low), F.lit(0), lambda acc, i: F.greatest(acc, to(i)))
        return F.when(F.element_at(p, -1) >= similarity * need, windows).otherwise(0)

    return F.get(F.transform(F.array(sums), widest), F.lit(0))


def find_leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = COVER, reach: int = 21, similarity: float = 0.8, least: int = 13, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Confirmed hits: __id, __text (hash), item_id and matched (most agreeing tokens in a window), a row for each document and item."""
    span = max(map(len, masks))
    most = 2 * least - 1
    context = max(most, span + reach)
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("item")).withColumn("len", F.size("item")).where(F.col("len") >= SHORT_SPAN)
    items = materialize(items.withColumn("item_no", F.monotonically_increasing_id()), "items")
    sizes = items.agg(F.count("*"), F.sum("len"), F.min("len"), F.sum(F.when(F.col("len") < span, 1).otherwise(0))).first()
    if not sizes[0]:
        return docs.select(F.col("doc_id").alias("__id"), F.lit(0).cast("long").alias("__text"), F.lit(0).cast("int").alias("matched"), F.lit(0).cast("long").alias("item_no")).where(F.lit(False)).join(items.select("item_no", "item_id"), "item_no").drop("item_no")
    used = masks + (("1" * SHORT_SPAN,) if sizes[3] else ())
    length = F.element_at(F.array(*[F.lit(len(m)) for m in used]), F.col("mask") + 1)

    def seeds(pieces: DataFrame, *keep: str) -> DataFrame:
        at = pieces.select(*keep, "c", F.explode_outer("places").alias("p"))
        return at.select(*keep, "c", "p", F.posexplode(_seeds(F.col("c"), F.col("p"), used)).alias("mask", "seed")).where(F.col("seed").isNotNull())

    parts = _pieces(items, ["item_no", "len"], "item", context).withColumn("part", F.col("item_no") * F.lit(1 << 20) + F.col("piece"))
    parts = materialize(parts.drop("piece"), "parts")
    tests = seeds(parts, "part", "len").where(F.when(F.col("mask") == len(masks), F.col("len") < span).otherwise(F.lit(True)))
    tests = tests.select("seed", "part", F.col("p").alias("q"))
    of = parts.select("part", "item_no", "len", F.col("c").alias("item"))
    small = sizes[1] * len(used) <= broadcast_rows
    if small:
        tests, of = F.broadcast(tests), F.broadcast(of)
    hashed = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), token_hashes(F.col("text")).alias("h"))
    pieces = _pieces(hashed, ["__id", "__text"], "h", context)
    if small:
        hits = seeds(pieces, "__id", "__text").join(tests, "seed")
    else:
        found = seeds(pieces, "__id", "__text", "piece").select("__id", "__text", "piece", "p", "mask", "seed").join(tests, "seed").drop("seed").distinct()
        again = pieces.select(F.col("__id").alias("i"), F.col("__text").alias("t"), F.col("piece").alias("k"), "c")
        hits = found.join(again, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__text") == F.col("t")) & (F.col("piece") == F.col("k")))
    hits = hits.join(of, "part")
    at = F.col("p") - F.col("q")  # where the item's piece would begin in the document's
    # a window around this seed that begins before it holds the same seed one place earlier, if that one is met too
    earlier = [reduce(Column.__and__, [F.get("c", F.col("p") + o - 1) == F.get("item", F.col("q") + o - 1) for o, bit in enumerate(m) if bit == "1"]) for m in used]
    chained = (F.col("p") > 0) & (F.col("q") > 0) & reduce(lambda c, k: c.when(F.col("mask") == k, earlier[k]), range(1, len(used)), F.when(F.col("mask") == 0, earlier[0]))
    low = F.when(chained, F.col("q")).otherwise(F.greatest(F.lit(0), F.col("q") - reach, -at))
    high = F.least(F.size("item"), F.col("q") + length + reach, F.size("c") - at)
    hits = hits.select("__id", "__text", "item_no", "c", "item", "q", at.alias("at"), low.alias("low"), high.alias("high"), (F.col("q") + length).alias("end"), F.least(F.lit(least), F.col("len")).alias("need"))
    found = _best(*[F.col(x) for x in ("c", "at", "item", "low", "high", "q", "end", "need")], most, similarity)
    hits = hits.select("__id", "__text", "item_no", found.alias("matched"))
    best = hits.where("matched > 0").groupBy("__id", "__text", "item_no").agg(F.max("matched").alias("matched"))
    return best.join(F.broadcast(items.select("item_no", "item_id")) if small else items.select("item_no", "item_id"), "item_no").drop("item_no")


def flag_documents(docs: DataFrame, benchmark: DataFrame, digest: bool = True, **options) -> DataFrame:
    """docs with contaminated, n_items (benchmark items found), item_id (of the best match, smallest on ties) and matched.

    digest=True keeps doc_id alone of the input's columns, so that no text is shuffled.
    """
    docs = without(docs, *OUT)
    leaks = find_leaks(docs, benchmark, **options)
    per_doc = leaks.groupBy("__id", "__text").agg(F.count_distinct("item_id").alias("n_items"), F.max_by("item_id", F.struct("matched", -F.col("item_id"))).alias("item_id"), F.max("matched").cast("long").alias("matched"))
    this, id_, text = unused(docs, "__hash"), unused(docs, "__id"), unused(docs, "__text")
    per_doc = materialize(per_doc.withColumnsRenamed({"__id": id_, "__text": text}), "leaks")
    left = (docs.select("doc_id", "text") if digest else docs).withColumn(this, F.xxhash64("text"))
    left = left.drop("text") if digest else left
    out = left.join(per_doc, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(this) == F.col(text)), "left").drop(id_, text, this)
    return out.withColumn("contaminated", F.col("n_items").isNotNull()).withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long"))).withColumn("matched", F.coalesce("matched", F.lit(0).cast("long")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs less the documents that hold text of the benchmark."""
    this, id_, text = unused(docs, "__hash"), unused(docs, "__id"), unused(docs, "__text")
    leaks = materialize(find_leaks(docs, benchmark, **options).select(F.col("__id").alias(id_), F.col("__text").alias(text)).distinct(), "leaks")
    rows = docs.withColumn(this, F.xxhash64("text"))
    return rows.join(leaks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(this) == F.col(text)), "left_anti").drop(this)


def leaks_sql(masks: tuple[str, ...] = MASKS, reach: int = 6, similarity: float = 0.8, least: int = 13) -> str:
    """flag_documents() in DuckDB's SQL (-1 for the item of a clean document), by longer seeds and whole windows only: equal where
    each passage of an item is whole."""
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    span = max(map(len, masks))
    every = [*masks, "1" * SHORT_SPAN]
    seeds = ", ".join(f"({k}, {len(m)}, {[i for i, bit in enumerate(m) if bit == '1']})" for k, m in enumerate(every))
    return f"""WITH m AS (SELECT * FROM (VALUES {seeds}) v(mask, span, places)),
      b AS (SELECT item_id, w, len(w) AS size FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {SHORT_SPAN}),
      d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {words} AS w FROM documents)),
      bp AS (SELECT item_id, w, mask, span, places, unnest(range(size - span + 1)) AS q FROM b, m WHERE size >= span AND (mask < {len(masks)} OR size < {span})),
      dp AS (SELECT doc_id, w, mask, span, places, unnest(range(n - span + 1)) AS p FROM d, m WHERE n >= span),
      bs AS (SELECT item_id, mask, span, q, list_transform(places, lambda o: w[q + o + 1]) AS seed FROM bp),
      ds AS (SELECT doc_id, mask, p, list_transform(places, lambda o: w[p + o + 1]) AS seed FROM dp),
      hits AS (SELECT DISTINCT doc_id, item_id, span, p - q AS base, q FROM ds JOIN bs USING (mask, seed)),
      sides AS (SELECT doc_id, item_id, base, d.w AS dw, b.w AS bw, size, greatest(0, q - {reach}, -base) AS low, least(size, q + span + {reach}, n - base) AS high FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
      found AS (SELECT doc_id, item_id, size, high - low AS width, list_sum(list_transform(range(low, high), lambda j: (dw[base + j + 1] = bw[j + 1])::INT)) AS matched FROM sides),
      best AS (SELECT doc_id, item_id, max(matched) AS matched FROM found WHERE width >= least({least}, size) AND matched >= {similarity} * width GROUP BY ALL),
      docs AS (SELECT doc_id, count(*) AS n_items, arg_max(item_id, matched * 1000000 - item_id) AS item_id, max(matched) AS matched FROM best GROUP BY doc_id)
      SELECT doc_id, docs.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_id, -1)::BIGINT AS item_id, coalesce(matched, 0)::BIGINT AS matched FROM documents LEFT JOIN docs USING (doc_id)"""
