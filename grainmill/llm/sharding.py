"""Operator 4: shards from a hierarchical weighted hash tree (region, rack, shard), in built-in functions only.

At each level a row draws -ln(u) / weight for every child, u from an md5 of the child's name and the row's id, and goes down
to the least draw. A child's draw depends on nothing else, so when a weight changes, rows move only into or out of that
child's subtree.

Growing adds the new shard as a region of its own ("annex") beside the old ones: no old node changes its weight, so a
row either keeps its place or moves to the new shard.

Slots number the rows of a shard from 0 without gaps. A single window over a shard would sort it in one task, so rows
are numbered inside small hash buckets and the buckets' counts, a table of shards * buckets rows, shift them.

Nulls: a null id is the text 'null'; a null text has size 8 and CRC 0. Repeated rows share a shard and get slots of
their own. An empty table gives an empty result. Input columns named like the output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_unit, id_text, materialize, without


@dataclass(frozen=True)
class Node:
    """name: unique in the tree; shard: its number for a leaf, else -1."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def _inner(name: str, children: tuple[Node, ...]) -> Node:
    return Node(name, sum(c.weight for c in children), children)


def hash_tree(shards: int, base: int = 24, regions: int = 2, racks: int = 3, weights: dict[int, float] | None = None) -> Node:
    """The tree of so many shards: the first `base` dealt over regions and racks, each later one an annex region. A shard of weight 0 takes no rows."""
    w = weights or {}
    if any(not 0 <= x < float("inf") for x in w.values()) or not any(w.get(s, 1.0) > 0 for s in range(shards)):
        raise ValueError("weights must be 0 or more, and one of them above 0")
    leaf = lambda s: Node(f"s{s}", float(w.get(s, 1.0)), (), s)
    first = min(base, shards)
    top = []
    for r in range(regions):
        inner = []
        for k in range(racks):
            own = tuple(leaf(s) for s in range(first) if s % regions == r and s // regions % racks == k and w.get(s, 1.0) > 0)
            if own:
                inner.append(_inner(f"r{r}k{k}", own))
        if inner:
            top.append(_inner(f"r{r}", tuple(inner)))
    top += [_inner(f"a{s}", (_inner(f"a{s}k0", (leaf(s),)),)) for s in range(first, shards) if w.get(s, 1.0) > 0]
    return _inner("root", tuple(top))


def _levels(root: Node) -> tuple[list[Node], list[list[int]], int]:
    """Nodes level by level, each one's children (a leaf's is itself), and the number of levels below the root."""
    nodes, depth, level = [root], 0, [root]
    while any(n.children for n in level):
        level = [c for n in level for c in n.children]
        nodes += level
        depth += 1
    number = {id(n): i for i, n in enumerate(nodes)}
    return nodes, [[number[id(c)] for c in n.children] or [i] for i, n in enumerate(nodes)], depth


def descend(df: DataFrame, root: Node, key: str, out: str) -> DataFrame:
    """df with the shard that the row's key descends to. The tree is a few literal arrays, indexed by the current node."""
    nodes, children, depth = _levels(root)
    below = F.array(*[F.lit(row) for row in children])
    weight, name, shard = F.lit([n.weight for n in nodes]), F.lit([n.name for n in nodes]), F.lit([n.shard for n in nodes])

    def draw(child: Column) -> Column:
        digest = F.md5(F.concat(F.get(name, child), F.lit(":"), F.col(key)).cast("binary"))
        return F.struct((-F.log(hex_unit(digest, 0)) / F.get(weight, child)).alias("draw"), child.alias("child"))

    df = df.withColumn("__node", F.lit(0))
    for _ in range(depth):
        df = df.withColumn("__node", F.array_min(F.transform(F.get(below, F.col("__node")), draw))["child"])
    return df.withColumn(out, F.get(shard, F.col("__node"))).drop("__node")


def _bucket(buckets: int) -> Column:
    """A row's bucket from an md5 of its id, size and CRC."""
    digest = F.md5(F.concat_ws(":", id_text(), F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, base: int = 24, buckets: int = 128, weights: dict[int, float] | None = None, digest: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more).

    digest=True keeps doc_id alone of the input's columns, so that no text is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = without(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = ["doc_id"] if digest else docs.columns
    sized = docs.select(*kept, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), id_text().alias("__key"))
    placed = descend(sized, hash_tree(shards, base, weights=weights), "__key", "shard")
    placed = descend(placed, hash_tree(shards + 1, base, weights=weights), "__key", "grown_shard").drop("__key")
    placed = placed.withColumn("__bucket", _bucket(buckets))
    if digest:  # else the texts would be written once more; they are placed twice instead
        placed = materialize(placed, "placed")
    counts = placed.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("__k", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(offsets), ["shard", "__bucket"])  # at most shards * buckets rows
        .withColumn("slot", F.col("__before") + F.col("__k") - 1)
        .withColumn("law", F.lit("key"))
        .select(*[c for c in placed.columns if c not in ("__bucket", "shard", "grown_shard", "size", "text_crc32")], "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )


def _place_sql(node: Node, key: str) -> str:
    if not node.children:
        return str(node.shard)
    unit = lambda c: f"((('0x' || substr(md5('{c.name}:' || {key}), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"
    draws = f"[{', '.join(f'-ln({unit(c)}) / {c.weight!r}' for c in node.children)}]"
    return f"(CASE list_position({draws}, list_min({draws})) " + " ".join(f"WHEN {i} THEN {_place_sql(c, key)}" for i, c in enumerate(node.children, 1)) + " END)"


def shard_sql(shards: int = 24, buckets: int = 128) -> str:
    """shard_documents() in DuckDB's SQL. The CRC is folded over the bytes, four bits at a time."""
    steps = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        steps.append(i)
    step = lambda c: f"xor({c} >> 4, {steps}[({c} & 15) + 1])"
    hexes = "'0123456789ABCDEF'"
    octets = f"list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ((instr({hexes}, x[1]) - 1) * 16 + instr({hexes}, x[2]) - 1)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step(step('xor(c, b)'))}), 4294967295::BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
      s AS (SELECT doc_id, k, strlen(t) + 8 AS size, {crc} AS text_crc32, {_place_sql(hash_tree(shards), "k")} AS shard, {_place_sql(hash_tree(shards + 1), "k")} AS grown_shard FROM d)
      SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
        row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || ':' || text_crc32 || ':' || size), 1, 8))::BIGINT % {buckets}, doc_id, text_crc32, size) - 1 AS slot FROM s"""
