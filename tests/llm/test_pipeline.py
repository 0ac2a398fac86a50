"""The pipeline's stages against plain versions of their decisions."""

import math
import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import types as T
from test_models import WORD, plain_base
from test_native import plain_match, plain_rake
from test_near_dedup import plain

from grainmill.llm import quality

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("__doc", T.StringType()), T.StructField("__text", T.StringType())])


def plain_features(text):
    """The statistics of one text, counted one by one."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n_words, chars, symbols, dup, repeated, _ = plain_base(text)
    data = text.encode()
    w, c, n = max(n_words, 1), max(chars, 1), max(len(lines), 1)
    count = lambda marks: sum(chr(b) in marks for b in data)
    return [
        math.log1p(n_words), chars / w, symbols / w, dup / n, repeated / w, sum(65 <= b <= 90 for b in data) / c, sum(48 <= b <= 57 for b in data) / c, count(".!?") / w,
        len(set(words)) / w if words else 1.0, n_words / n, math.log1p(max((len(x.encode()) for x in words), default=0)), count("|") / w, count(",;:!?\"'()[]{}") / w,
    ]


def walked(forest, x):
    """The forest's probability, node by node."""
    score = forest.start
    for at in forest.roots:
        for _ in range(forest.depth):
            at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        score += forest.value[at]
    return 1 / (1 + math.exp(-score))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.asDict() for r in rows.collect()}
        rows = stage(spark, rows, sf_dir).persist()
        assert rows.columns == columns, name
        kept[name] = before, {r.doc_id for r in rows.select("doc_id").collect()}
        assert kept[name][1] <= set(before)
    texts = lambda before: {i: r["text"] or "" for i, r in before.items()}

    before, after = kept["quality rules"]
    forest = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert after == {i for i, t in texts(before).items() if not plain_base(t)[-1] and walked(forest, plain_features(t)) >= 0.5}

    before, after = kept["MinHash near-dedup"]
    assert after == {i for i, (_, _, first) in plain(list(texts(before).items()), 5).items() if first}

    before, after = kept["benchmark decontamination"]
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [x for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(x := tokens(r.text)) >= 5]
    found = set()
    for i, text in texts(before).items():
        doc = tokens(text)
        have = set(doc)
        if any(sum(w in have for w in x) >= 0.8 * min(13, len(x)) and plain_match(doc, x) for x in items):
            found.add(i)
    assert after == set(before) - found and found

    before, after = kept["mixing to target weights"]
    topic = lambda t, n: "table" if " | " in t else "contact" if "@" in t or "http" in t else "short" if n < 60 else "prose"
    size = {i: max(len(WORD.findall(t)), 1) for i, t in texts(before).items()}
    cell = {i: (r["source"], r["lang"], topic(r["text"] or "", size[i])) for i, r in before.items()}
    own = dict.fromkeys(cell.values(), 0)
    for i, k in cell.items():
        own[k] += size[i]
    w, _ = plain_rake(own, 12, 0.7)
    factor = {k: w[k] / own[k] for k in own}
    low, high = 0.0, 1e12  # the scale at which the expected tokens are 80 % of all
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(n * min(1, middle * factor[k]) for k, n in own.items()) < 0.8 * sum(own.values()) else (low, middle)
    draw = lambda i, t: (int(md5(f"mix:{i}:{md5(t)}")[:8], 16) + 0.5) / 2**32
    sure = {i: draw(i, t) - min(1, low * factor[cell[i]]) for i, t in texts(before).items()}
    assert all((i in after) == (d < 0) for i, d in sure.items() if abs(d) > 1e-6)

    out = corpus_pipeline.STAGES[4][1](spark, rows, sf_dir)
    assert set(columns) <= set(out.columns) and out.count() == rows.count()
    sizes = {r.doc_id: len((r.text or "").encode()) + 8 for r in rows.collect()}
    assert {r.doc_id: r["size"] for r in out.collect()} == sizes
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in out.collect())


def md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


PROSE = "The river ran past the old mill where the miller kept his books and every evening he wrote down how much grain had come. Nobody read them but the cat."


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (1, ""), (1, None), (2, PROSE), (2, PROSE), (3, PROSE + " x"), (None, PROSE), (4, "word " * 30_000), (5, " \n\t")]])
def test_nulls_repeats_and_empty_tables(spark, sf_dir, rows):
    """Every stage alone, on nulls in any column, repeated rows, empty and long texts, columns named like the operators' own, and no rows."""
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None, f"d{k}", f"t{k}") for k, (i, t) in enumerate(rows)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = [r.asDict() for r in out.collect()]
        assert set(docs.columns) <= set(out.columns), name
        whole = {(r["doc_id"], r["text"], r["__doc"], r["__text"]) for r in got}
        assert whole <= {(r.doc_id, r.text, r["__doc"], r["__text"]) for r in docs.collect()}, name
        if name == "MinHash near-dedup" and rows:
            assert sorted(str(r["doc_id"]) for r in got if r["text"] and PROSE in r["text"]) == ["None"]
        if name == "sharding":
            assert len(got) == len(rows)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(0 <= r.shard < 24 for r in out)
