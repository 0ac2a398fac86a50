"""Operator 1: near duplicates by an inverted join over MinHash signature coordinates.

A document is its set of distinct shingles of `shingle` consecutive words (lower-cased A-Z); two documents are linked if
the intersection of their sets is at least `percent` of the union. Documents with equal sets form a class, represented
by its first. A coordinate's value is the two least hashes of the set under the coordinate's permutation (two, so that
common shingles alone bring few documents together, however many there are); it is equal in two sets with about the
square of their similarity as probability. A class is posted under each of its (coordinate, value) pairs. Two classes
are a candidate if they meet in `matches` of the `coordinates` or more:

- prefix: pairs that only one class has are dropped. A class's remaining pairs are ordered from the rarest to the most
  common over the corpus; two classes with `matches` pairs in common must meet in the first size - matches + 1 of each,
  so only these are joined, and a class with fewer pairs than `matches` left is done.
- skip: a posting list is not expanded into all its pairs. In a round every class of a list meets the list's hubs only;
  confirmed links are merged into components, and members of one component are skipped from then on. When the lists
  have little left between components, what is left is joined in full, so no link between components is lost; this
  join's condition counts the collisions and compares sketches of the sets, so it gives out hardly more than links. A
  list of more than LIST classes is dealt into blocks, which meet two by two in cells of their own.

Candidates with `matches` collisions or more are confirmed on the full shingle sets of both whole texts. At 80 percent
a pair right at the limit is missed with probability 3e-4 (sets of 9 or 10 shingles: 9e-4), one of 84 percent with 5e-6,
unless other links join their components; the sketches lose another 3e-7 at most. Short texts, for which two coordinates
agree less often, are joined exactly beside that: where the smaller set has so few shingles that a link of two sets means
that one holds the other (8 at 80 percent), sets are looked up under what is left of larger ones less one or two shingles.

Shingles are compared by 64-bit hashes, sets of a class by two. Nulls: a null, empty or blank text has an empty set and
is linked with nothing; a null doc_id comes before all others. Rows of one id with different texts are different
documents; equal rows are one class. An empty table gives an empty result. Input columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LOWER, Block, Spans, arrays, blocks, chain, mix, signed, words
from .common import WORD, materialize
from .components import components
from .repeats import first_of_owner, most_repeats, packed, unpacked, with_row_ids


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, document by document, and each document's first (and the end)."""
    low = LOWER[block.data]
    starts, ends, first = words(low, block.offsets)
    hashes = Spans(low).hash(starts, ends)
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    runs = chain(hashes, size)
    whole = owner[: len(runs)] == owner[size - 1 :] if len(runs) else np.zeros(0, bool)
    h, doc = runs[whole], owner[: len(runs)][whole]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    if len(short):
        more = np.array([chain(hashes[first[i] : first[i + 1]], int(first[i + 1] - first[i]))[0] for i in short], np.uint64)
        h, doc = np.concatenate((h, more)), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    once = first_of_owner(doc, h)
    h, doc = h[once], doc[once]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _less(total: np.uint64, parts: np.ndarray) -> list[int]:
    """The sum of a set's hashes less each one, then less each two."""
    a, b = np.triu_indices(len(parts), 1)
    return signed(np.concatenate((total - parts, total - parts[a] - parts[b]))).tolist()


def _sign(batches: Iterator[pa.RecordBatch], size: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    random = np.random.default_rng(20_240_601)
    masks = random.integers(0, 1 << 32, coordinates, dtype=np.uint32)
    factors = random.integers(0, 1 << 32, coordinates, dtype=np.uint32) | np.uint32(1)
    for batch in batches:
        for block in blocks(batch.column("text")):
            h, first = shingles(block, size)
            n = np.diff(first)
            some = np.flatnonzero(n)
            at = first[:-1][some]
            signature = np.zeros((len(some), coordinates), np.int64)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                short = (h >> np.uint64(32)).astype(np.uint32)
                sizes = n[some]
                for k in range(coordinates):
                    v = (short ^ masks[k]) * factors[k]
                    least = np.minimum.reduceat(v, at)
                    v[v == np.repeat(least, sizes)] = np.iinfo(np.uint32).max
                    both = least.astype(np.uint64) << np.uint64(32) | np.minimum.reduceat(v, at)
                    signature[:, k] = signed(mix(both + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15 >> 8)))
                m1, m2 = mix(h), mix(h ^ np.uint64(0x9E3779B97F4A7C15))
                s1[some], s2[some] = np.add.reduceat(m1, at), np.add.reduceat(m2, at)
            less: list[tuple[list[int], list[int]]] = [([], [])] * len(n)
            for i in np.flatnonzero((n > 4) & (n <= SMALL + 2)).tolist() if len(some) else ():
                mine = slice(first[i], first[i + 1])
                less[i] = (_less(s1[i], m1[mine]), _less(s2[i], m2[mine]))
            full = np.concatenate(([0], np.cumsum(n > 0)))
            rows = batch.slice(block.lo, block.hi - block.lo)
            columns = [rows.column("doc_id"), rows.column("__doc"), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2))]
            columns.append(arrays(signature.ravel(), full * coordinates, pa.int64()))
            columns += [pa.array([x[k] for x in less], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "__doc", "n", "s1", "s2", "signature", "less1", "less2"])


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(rep, sketch): the SKETCH least 32-bit hashes of a class's shingles, all of them if there are no more."""
    for batch in batches:
        for block in unpacked(batch):
            h, first = shingles(block, size)
            parts = [np.unique(h[a:b].astype(np.uint32).view(np.int32))[:SKETCH] for a, b in zip(first[:-1], first[1:], strict=True)]
            lists = arrays(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(block.lo, block.hi - block.lo), lists], ["rep", "sketch"])


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) whose texts' shingle sets reach the percentage."""
    held: OrderedDict[int, np.ndarray] = OrderedDict()

    def known(ids: np.ndarray, zs: pa.Array, sizes: pa.Array) -> list[np.ndarray]:
        fresh = [i for i, x in enumerate(ids.tolist()) if x not in held]
        fresh = list({int(ids[i]): i for i in fresh}.values())
        if fresh:
            part = pa.RecordBatch.from_arrays([zs.take(pa.array(fresh)), sizes.take(pa.array(fresh))], ["z", "size"])
            for block in unpacked(part):
                h, first = shingles(block, size)
                for i in range(block.hi - block.lo):
                    held[int(ids[fresh[block.lo + i]])] = np.sort(h[first[i] : first[i + 1]])
        return [held[x] for x in ids.tolist()]

    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            a, b = known(u, batch.column("zu"), batch.column("size_u")), known(v, batch.column("zv"), batch.column("size_v"))
            good = np.zeros(len(u), bool)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], ["u", "v"])
            while len(held) > 500:
                held.popitem(last=False)


#: Most hashes in a sketch.
SKETCH = 512
#: Classes of a block of a posting list.
LIST = 4096
#: Sets of so many shingles or fewer are looked up whole under larger ones less one or two.
SMALL = 8


def small_links(classes: DataFrame, percent: int) -> DataFrame:
    """(u, v): links of a set of SMALL shingles or fewer and one that holds it and one or two more, by the sums of their hashes."""
    own = classes.where(F.col("n") <= SMALL).select(F.col("rep").alias("a"), "n", "s1", "s2")
    parts = classes.where(F.size("less1") > 0).select(F.col("rep").alias("b"), F.col("n").alias("whole"), F.posexplode(F.arrays_zip("less1", "less2")).alias("k", "x"))
    parts = parts.select("b", "whole", (F.col("whole") - F.when(F.col("k") < F.col("whole"), 1).otherwise(2)).alias("n"), F.col("x.less1").alias("s1"), F.col("x.less2").alias("s2"))
    parts = parts.where(100 * F.col("n") >= percent * F.col("whole"))
    return own.join(parts, ["n", "s1", "s2"]).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


class _Search:
    """The rounds over the posting lists of the classes that can have a partner."""

    def __init__(self, classes: DataFrame, texts: DataFrame, size: int, percent: int, matches: int):
        self.size, self.percent, self.matches = size, percent, matches
        posted = classes.select("rep", F.explode("signature").alias("pair"))
        counts = posted.groupBy("pair").agg(F.count("*").alias("f")).where("f > 1")
        shared = posted.join(counts, "pair").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "pair"))).alias("pairs")).where(F.size("pairs") >= matches)
        shared = shared.join(classes.select("rep", "n"), "rep")
        self.live = materialize(shared.select("rep", "n", F.col("pairs.pair").alias("pairs")), "live")
        self.lists = self.live.select("rep", "n", F.explode(self.prefix("pairs")).alias("pair"))
        self.texts = materialize(texts.join(self.live.select(F.col("rep").alias("__doc")), "__doc", "left_semi").select(F.col("__doc").alias("rep"), "size", "z").dropDuplicates(["rep"]), "texts")
        self.links: DataFrame | None = None
        self.tried: DataFrame | None = None

    def prefix(self, pairs: str) -> Column:
        return F.slice(pairs, F.lit(1), F.size(pairs) - self.matches + 1)

    def labelled(self, found: DataFrame | None) -> DataFrame:
        """The posting lists with each class's component, lists within one component left out."""
        if found is None:
            rows = self.lists.withColumn("component", F.col("rep"))
        else:
            rows = self.lists.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        rows = materialize(rows, "lists")
        open_lists = rows.groupBy("pair").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("pair")
        return materialize(rows.join(open_lists, "pair", "left_semi"), "open")

    def hub_pairs(self, lists: DataFrame, turn: int) -> DataFrame:
        """Each class with two hubs at most of its lists that lie in other components, those met in most lists."""
        hubs = lists.groupBy("pair").agg(
            F.min(F.struct("component", "rep"))["rep"].alias("h0"), F.max(F.struct("component", "rep"))["rep"].alias("h1"), F.min(F.struct(F.xxhash64("pair", "rep", F.lit(turn)).alias("x"), "rep", "component"))["rep"].alias("h2")
        )
        hubs = hubs.select("pair", F.explode(F.array_distinct(F.array("h0", "h1", "h2"))).alias("hub"))
        of = lists.select(F.col("rep").alias("hub"), F.col("component").alias("hub_component"), "pair").join(hubs, ["pair", "hub"])
        met = lists.join(of, "pair").where("component <> hub_component")
        met = met.groupBy("rep", "hub").agg(F.count("*").alias("c"))
        best = met.withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("c"), "hub"))).where("k <= 2")
        return best.select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct()

    def all_pairs(self, lists: DataFrame) -> DataFrame:
        """Every two classes of one list that lie in different components and can be linked by their sizes and collisions, each once: from the first list that both share."""
        size = self.size
        sketches = self.texts.join(lists.select("rep").distinct(), "rep", "left_semi").mapInArrow(lambda it: _sketch(it, size), "rep long, sketch array<int>")
        long = lists.groupBy("pair").agg(F.ceil(F.count("*") / LIST).alias("blocks")).where("blocks > 1")
        dealt = lists.join(long, "pair", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("blocks", "other")
        whole = dealt.join(self.live.select("rep", F.transform("pairs", lambda x: F.hash(x)).alias("p")), "rep").join(sketches, "rep").withColumn("h", F.hash("pair"))
        side = lambda x: whole.select("pair", "x", "y", F.col("block").alias(f"b_{x}"), "h", F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"), F.col("p").alias(f"p_{x}"), F.col("sketch").alias(f"s_{x}"))
        u, v = side("u"), side("v")
        near = (F.col("u") < F.col("v")) & (F.col("c_u") != F.col("c_v")) & (100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v"))
        first = F.get(F.array_intersect(self.prefix("p_u"), self.prefix("p_v")), F.lit(0)) == u["h"]
        cell = (u["pair"] == v["pair"]) & (u["x"] == v["x"]) & (u["y"] == v["y"]) & ((F.col("b_u") != F.col("b_v")) | (u["x"] == u["y"]))
        return u.join(v, cell & near & first & self.meet() & self.alike()).select("u", "v")

    def meet(self) -> Column:
        """Whether the sides u and v meet in enough of the posted coordinates."""
        return F.size(F.array_intersect("p_u", "p_v")) >= self.matches

    def alike(self) -> Column:
        """Whether the sketches of u and v allow a link: the sets themselves (less one for hashes that fall together) if they
        are no larger than a sketch, else the least hashes of their union, 5 deviations below the limit."""
        common = F.array_intersect("s_u", "s_v")
        both, sizes = F.size(common), F.size("s_u") + F.size("s_v")
        whole = 100 * (both + 1) >= self.percent * (sizes - both - 1)
        share = F.size(F.array_intersect(F.slice(F.array_sort(F.array_union("s_u", "s_v")), 1, SKETCH), common)) / F.lit(float(SKETCH))
        limit = self.percent / 100
        return F.when((F.size("s_u") < SKETCH) & (F.size("s_v") < SKETCH), whole).otherwise(share >= limit - 5 * (limit * (1 - limit) / SKETCH) ** 0.5)

    def left_over(self, lists: DataFrame) -> tuple[int, int]:
        """Pairs between components that the lists still hold, and the lists' rows."""
        each = lists.groupBy("pair", "component").agg(F.count("*").alias("c")).groupBy("pair").agg(F.sum("c").alias("s"), F.sum(F.col("c").cast("double") * F.col("c")).alias("q"))
        pairs, rows = each.agg(F.sum((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2), F.sum("s")).first()
        return int(pairs or 0), int(rows or 0)

    def confirm(self, pairs: DataFrame) -> float:
        """Count the collisions of new pairs, check those above the threshold on the texts and keep the links; the share of the pairs that are links."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs", cleanup=False)
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        side = lambda x: self.live.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("pairs").alias(f"p_{x}"))
        good = pairs.join(side("u"), "u").join(side("v"), "v")
        good = good.where(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v")).where(self.meet()).select("u", "v")
        text = lambda x: self.texts.select(F.col("rep").alias(x), F.col("size").alias(f"size_{x}"), F.col("z").alias(f"z{x}"))
        size, percent = self.size, self.percent
        found = good.join(text("u"), "u").join(text("v"), "v").mapInArrow(lambda it: _confirm(it, size, percent), "u long, v long")
        found = materialize(found, "found", cleanup=False)
        self.links = found if self.links is None else self.links.unionByName(found)
        return found.count() / max(1, pairs.count())


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, coordinates: int = 64, matches: int = 28, rounds: int = 2, slack: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and __doc and __component, the row ids behind them (for joins).

    rounds: most hub rounds; they end as soon as the lists hold fewer than `slack` pairs between components for each of
    their rows, or when a round confirms few of its pairs. Then all that are left are joined.
    """
    docs = with_row_ids(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed_docs = docs.mapInArrow(lambda it: _sign(it, shingle, coordinates), f"doc_id {kind}, __doc long, n long, s1 long, s2 long, signature array<long>, less1 array<long>, less2 array<long>")
    signed_docs = materialize(signed_docs, "signatures")
    classes = signed_docs.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("__doc").alias("rep"), *[F.first(c).alias(c) for c in ("signature", "less1", "less2")])
    classes = materialize(classes, "classes")
    search = _Search(classes, packed(docs), shingle, percent, matches)
    search.links = materialize(small_links(classes, percent), "small", cleanup=False)
    found = None
    lists = search.labelled(None)
    for turn in range(rounds):
        left, rows = search.left_over(lists)
        if not left or (turn and left <= slack * rows):
            break
        gain = search.confirm(search.hub_pairs(lists, turn))
        found = components(search.links)
        lists = search.labelled(found)
        if gain < 0.02:
            break
    if search.left_over(lists)[0]:
        search.confirm(search.all_pairs(lists))
        found = components(search.links)
    if found is None and search.links.limit(1).count():
        found = components(search.links)
    members = signed_docs.select("doc_id", "__doc", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left")
    if found is not None:
        members = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    else:
        members = members.withColumn("component", F.col("rep"))
    members = members.withColumn("__component", F.coalesce("component", "rep", "__doc"))
    return _with_component_id(members, docs)


def _with_component_id(members: DataFrame, docs: DataFrame) -> DataFrame:
    """component_id: the doc_id behind __component. Row ids that are the doc_ids themselves need no join."""
    members = members.withColumn("__same", F.coalesce(F.col("doc_id").cast("long") == F.col("__doc"), F.lit(False)))
    plain = members.where(~F.col("__same") & F.col("doc_id").isNotNull()).limit(1).count() == 0
    if plain:
        first_null = F.when(F.col("__component") == F.lit(-(1 << 63)), F.lit(None)).otherwise(F.col("__component"))
        out = members.withColumn("component_id", first_null)
    else:
        ids = docs.select(F.col("__doc").alias("__component"), F.col("doc_id").cast("long").alias("component_id")).distinct()
        out = members.join(ids, "__component")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").cast("long").eqNullSafe(F.col("component_id")).alias("kept"), "__doc", "__component")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs less all but the first document of each group of near duplicates; of rows equal in id and text one stays.

    Documents without words are in no group and stay.
    """
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]  # the input may have columns named like ours
    plain = docs.toDF(*names)
    found = near_duplicates(plain, **options)
    gone = materialize(found.where("__doc <> __component").select("__doc").distinct(), "copies")
    rows = with_row_ids(plain, whole=True)
    if most_repeats(plain) > 1:
        rows = rows.dropDuplicates(["__doc"])
    return rows.join(gone, "__doc", "left_anti").select(*names).toDF(*docs.columns)


def components_sql(percent: int = 80) -> str:
    """near_duplicates() for shingles of two words in DuckDB's SQL, over all pairs that share a shingle."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS w FROM documents),
      s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS s FROM d),
      e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
      links AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
      both_ways AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
      reach(i, j) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON r.j = b.i),
      c AS (SELECT i AS doc_id, min(j) AS component_id FROM reach GROUP BY i)
      SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
