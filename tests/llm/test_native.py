"""Operators 3, 4 and 9 against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import types as T

from grainmill.llm import decontaminate, mixing, sharding

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("kept", T.StringType())])
BENCH = "item_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "x", "y") for i, t, lang, src in rows], DOCS).repartition(3)


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 120))), rng.choice(["de", "en", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}") for i in range(n)]
    return rows + [(None, None, None, None), (None, None, None, None), (n, "", "en", "s1"), (n, "", "en", "s1")]


def put(node, key):
    while node.children:
        draws = []
        for k, child in enumerate(node.children):
            u = (int(hashlib.md5(f"{child.name}:{key}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
            draws.append((-math.log(u) / child.weight, k))
        node = node.children[min(draws)[1]]
    return node.shard


def test_shards(spark):
    rows = sample(800)
    out = sharding.shard_documents(docs(spark, rows)).collect()
    texts = {i: t or "" for i, t, _, _ in rows}
    tree, grown = sharding.hash_tree(24), sharding.hash_tree(25)
    assert len(out) == len(rows)
    slots = collections.defaultdict(list)
    for r in out:
        key = "null" if r.doc_id is None else str(r.doc_id)
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "key", put(tree, key), put(grown, key))
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_follow_weights(spark):
    out = sharding.shard_documents(docs(spark, [(i, "t", "en", "s") for i in range(4000)]), weights={0: 5.0}).groupBy("shard").count().collect()
    n = {r.shard: r["count"] for r in out}
    assert abs(n[0] - 4000 * 5 / 28) < 120 and len(n) == 24


def test_weight_change_moves_rows_within_its_subtrees(spark):
    rows = docs(spark, [(i, "t", "en", "s") for i in range(2000)])
    a = {r.doc_id: r.shard for r in sharding.shard_documents(rows).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_documents(rows, weights={0: 3.0}).collect()}
    region = lambda s: s % 2
    assert all(region(b[i]) == 0 for i in a if a[i] != b[i])


def test_empty_tables(spark):
    none = docs(spark, [])
    assert sharding.shard_documents(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
    assert decontaminate.flag_documents(none, spark.createDataFrame([], BENCH)).count() == 0
    assert decontaminate.flag_documents(docs(spark, sample(5)), spark.createDataFrame([], BENCH)).where("contaminated").count() == 0


def plain_rake(cells, sweeps, alpha):
    total = sum(cells.values())
    targets = []
    for d in range(3):
        own = collections.Counter()
        for k, v in cells.items():
            own[k[d]] += v
        raw = {k: v**alpha for k, v in own.items()}
        targets.append({k: v / sum(raw.values()) for k, v in raw.items()})
    w = {k: v / total for k, v in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            have = collections.Counter()
            for k, v in w.items():
                have[k[d]] += v
            w = {k: v * targets[d][k[d]] / have[k[d]] for k, v in w.items()}
    return w, targets


def test_raking(spark):
    rows = sample(600)
    out = mixing.mix_documents(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    cells = collections.Counter()
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    w, targets = plain_rake(cells, 12, 0.7)
    total = sum(cells.values())
    for r in out:
        k = (r.source, r.lang, r.topic)
        assert r.weight == pytest.approx(w[k] / cells[k] * total, rel=1e-6)
    have = collections.Counter()
    for k, v in w.items():
        have[k[2]] += v
    assert all(have[t] == pytest.approx(x) for t, x in targets[2].items())
    expected = sum(r.n_tokens * r.probability for r in out)
    assert expected == pytest.approx(0.8 * total, rel=1e-6)
    assert {r.kept for r in out if r.probability == 1.0} <= {True}


def test_mixing_to_given_targets(spark):
    rows = [(i, "a b c d " * 20, "en", "x" if i % 4 else "y") for i in range(2000)]
    out = mixing.mix_documents(docs(spark, rows), targets={"source": {"x": 0.5, "y": 0.5}}, keep=0.3).where("kept").groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["x"] - n["y"]) < 90


ITEMS = [(1, " ".join(f"Q{i}" for i in range(40))), (2, " ".join(f"z{i}" for i in range(15))), (3, "alpha beta, gamma delta epsilon"), (4, "two words"), (5, None)]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_leaks(spark, most):
    rng = random.Random(2)
    noise = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    swapped = " ".join("xx" if i % 9 == 4 else f"q{i}" for i in range(40))
    rows = [
        (10, f"{noise(50)} {ITEMS[0][1]} {noise(30)}"), (11, f"{noise(500)} {swapped.upper()}"), (12, f"z0 {' '.join(f'z{i}' for i in range(1, 15))}."), (13, f"{noise(9)} ALPHA beta gamma; delta epsilon {noise(5)}"),
        (14, noise(300)), (15, "two words"), (16, f"{noise(20)} q3 q4 q5 q6 {noise(20)}"), (17, None), (18, ""), (19, " ".join(f"q{i}" for i in range(10, 30))), (None, ITEMS[0][1]), (None, "clean text"),
    ]
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    bench = spark.createDataFrame(ITEMS, BENCH)
    out = decontaminate.flag_documents(df, bench, broadcast_rows=most).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or 0, r.item_id) for r in out if r.contaminated) == [(0, 1), (10, 1), (11, 1), (12, 2), (13, 3), (19, 1)]
    kept = decontaminate.drop_contaminated(df, bench, broadcast_rows=most)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 14, 15, 16, 17, 18]


def test_short_passages_out_of_an_item(spark):
    """Verbatim runs wherever in the item, set into other text: 11 are 80 % of a window of 13, 10 are too few."""
    item = " ".join(f"q{i}" for i in range(40))
    noise = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    runs = [(lo, n) for n in (10, 11, 13, 14, 15, 19, 20) for lo in (0, 11, 40 - n)]
    rows = [(k, f"{noise(k, 30)} {' '.join(f'q{i}' for i in range(lo, lo + n))} {noise(-k, 30)}", "en", "s") for k, (lo, n) in enumerate(runs)]
    out = decontaminate.flag_documents(docs(spark, rows), spark.createDataFrame([(1, item)], BENCH)).collect()
    got = {runs[r.doc_id]: r.matched if r.contaminated else 0 for r in out}
    assert got == {(lo, n): n if n >= 11 else 0 for lo, n in runs}


def test_replaced_tokens(spark):
    """Whole items with up to a fifth of their tokens replaced, anywhere, are found; one more and they are not."""
    rng = random.Random(5)
    sizes = [5, 7, 8, 9, 10, 12, 13, 14, 15, 16, 20, 25, 30]
    items = [(n, " ".join(f"i{n}q{k}" for k in range(n))) for n in sizes]
    cases = [(n, {k}) for n in sizes for k in range(n)] + [(13, {0, 12}), (15, {3, 7, 11}), (20, {3, 7, 11, 15}), (25, {4, 9, 14, 19, 24})]
    cases += [(n, set(rng.sample(range(n), n // 5))) for n in sizes for _ in range(20)]
    bad = [(n, set(rng.sample(range(n), n // 5 + 1))) for n in (5, 7, 8, 9, 10, 12, 13) for _ in range(5)]
    text = lambda n, gone: " ".join("xx" if k in gone else f"i{n}q{k}" for k in range(n))
    rows = [(i, f"some words {text(n, gone)} and others", "en", "s") for i, (n, gone) in enumerate(cases + bad)]
    out = decontaminate.flag_documents(docs(spark, rows), spark.createDataFrame(items, BENCH)).collect()
    assert {r.doc_id for r in out if r.contaminated} == set(range(len(cases)))


def test_no_python_in_native_plans(spark, sf_dir):
    from grainmill.llm import queries

    for name in ("op3_spaced_seed_decontamination", "op4_hash_tree_sharding", "op9_raked_mixing"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_match(doc, item, least=13, similarity=0.8):
    """The most agreeing tokens in any window that the definition allows, over all ways to lay the texts side by side."""
    need, best = min(least, len(item)), 0
    for at in range(1 - len(item), len(doc)):
        low, high = max(0, -at), min(len(item), len(doc) - at)
        agree = [doc[at + j] == item[j] for j in range(low, high)]
        for i in range(len(agree)):
            for size in range(need, min(2 * least - 1, len(agree) - i) + 1):
                if sum(agree[i : i + size]) >= similarity * size:
                    best = max(best, sum(agree[i : i + size]))
    return best


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_leaks_against_all_windows(spark, most):
    """Few words, so that everything meets everything; texts over several pieces, with runs and periods."""
    rng = random.Random(9)
    words = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    items = [words(rng.choice([5, 8, 13, 30, 60]), 9) for _ in range(5)] + [["z"] * 40, ["z", "y"] * 15, ["w1"] * 6 + words(10, 9) + ["z"] * 30]
    texts = [words(rng.randrange(1, 90), 9) for _ in range(10)] + [["z"] * 330, ["y", "z"] * 150 + ["w1"] * 9, words(120, 9) + items[2] + words(30, 9), ["a", "b", "c", "z"] * 70 + items[7][:20]]
    df = docs(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])
    got = {(r["__id"], r.item_id): r.matched for r in decontaminate.find_leaks(df, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], BENCH), broadcast_rows=most).collect()}
    expected = {(i, k): plain_match(t, x) for i, t in enumerate(texts) for k, x in enumerate(items)}
    assert got == {pair: n for pair, n in expected.items() if n}


def test_repeated_tokens_on_both_sides(spark):
    """Texts of one token, of two in turn and of a table's row, 5,000 long: bounded work, and found."""
    texts = ["0 " * 5000, "0 1 " * 2500, "a 0 0 | " * 1500, "0 " * 12]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(1, "0 " * 5000), (2, "a 0 0 " * 1500)], BENCH)
    out = {r.doc_id: (r.n_items, r.matched) for r in decontaminate.flag_documents(df, bench).collect()}
    assert out == {0: (1, 25), 1: (0, 0), 2: (1, 25), 3: (0, 0)}


def test_clashing_columns_stay(spark):
    rows = spark.createDataFrame([(1, ITEMS[0][1], "p", "q", "r"), (2, "clean", "s", "t", "u")], "doc_id long, text string, __id string, __text string, __hash string")
    bench = spark.createDataFrame(ITEMS, BENCH)
    kept = decontaminate.drop_contaminated(rows, bench)
    assert [tuple(r) for r in kept.collect()] == [(2, "clean", "s", "t", "u")]
    out = decontaminate.flag_documents(rows, bench, digest=False)
    assert sorted((r.doc_id, r["__id"], r["__text"], r["__hash"], r.contaminated) for r in out.collect()) == [(1, "p", "q", "r", True), (2, "s", "t", "u", False)]


def test_given_topics_are_raked(spark):
    rows = [(i, "a b c d " * 20, "en", "x", "rare" if i % 10 == 0 else "common") for i in range(2000)] + [(5000, "a b", "en", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    out = mixing.mix_documents(df, targets={"topic": {"rare": 0.5, "common": 0.5}}, keep=0.15)
    n = {r.topic: r["count"] for r in out.where("kept").groupBy("topic").count().collect()}
    assert {r.topic for r in out.collect()} == {"rare", "common", None} and abs(n["rare"] - n["common"]) < 60
    whole = mixing.mix_documents(df, digest=False)
    assert whole.columns[:5] == df.columns


def test_shards_of_no_weight(spark):
    out = sharding.shard_documents(docs(spark, [(i, "t", "en", "s") for i in range(500)]), weights={3: 0.0, 7: 0.0}).collect()
    assert not {3, 7} & {r.shard for r in out} and len(out) == 500
    for bad in ({1: -1.0}, dict.fromkeys(range(24), 0.0)):
        with pytest.raises(ValueError, match="weights"):
            sharding.hash_tree(24, weights=bad)
