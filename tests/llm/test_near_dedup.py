"""Operator 1 against all pairs, and connected components against union-find."""

import random
import re

import pytest
from pyspark.sql import types as T

from grainmill.llm import components, near_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()), T.StructField("__x", T.StringType())])


def sets(rows, size):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().translate(low))
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def plain(rows, size=2):
    s = sets(rows, size)
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i), find(i) == i) for i in s}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "of", "é"]
    rows = [(1, None), (2, ""), (3, "\n \t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "of the " * 3000)]
    for base in range(10):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 300))]
        for k in range(rng.randrange(1, 15)):
            copy = [w if rng.random() > 0.05 * (k % 3) else rng.choice(words) for w in text]
            rows.append((100 * (base + 1) + k, " ".join(copy)))
    core = [rng.choice(words) for _ in range(100)]
    rows += [(5000 + k, " ".join(core + [rng.choice(words) for _ in range(rng.randrange(40))])) for k in range(60)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA).repartition(3)


def test_against_all_pairs(spark):
    rows = corpus(1)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain(rows)


def test_residual_join_alone_finds_all_links(spark):
    """Without hub rounds everything must come from the full join of the lists."""
    rows = corpus(2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), rounds=0).collect()}
    assert got == plain(rows)


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text), (2, text), (3, text + " more"), (None, text), (9, None), (9, None), (4, "other words stand here now")]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    kept = near_dedup.keep_first(df, shingle=5)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 4), (False, 9), (True, 0)]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500 + k) for k in range(1, 50)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)


def test_short_texts_and_blocks_of_lists(spark, monkeypatch):
    """All sets of 1 to 11 shingles near the limit, each link missed or met alone; posting lists in blocks of three."""
    monkeypatch.setattr(near_dedup, "LIST", 3)
    rng = random.Random(6)
    rows, at = [(0, "a b"), (1, "a b c")], 10
    for n in range(3, 13):
        for _ in range(25):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(at, " ".join(words)), (at + 1, " ".join(words + ["x"])), (at + 2, " ".join(["y", *words, "x"])), (at + 3, " ".join(["z", "z2", *words]))]
            at += 4
    core = [f"c{k}" for k in range(60)]
    rows += [(90_000 + k, " ".join(core + [f"t{rng.randrange(400)}" for _ in range(rng.randrange(8, 40))])) for k in range(80)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), rounds=0).collect()}
    assert got == plain(rows)


def test_clashing_columns_and_other_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(2, text, "p", 1), (1, text, "q", 2)], "doc_id long, text string, __doc string, n int")
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, text, "q", 2)]
    with pytest.raises(TypeError, match="whole number"):
        near_dedup.near_duplicates(spark.createDataFrame([("a", text)], "doc_id string, text string"))
