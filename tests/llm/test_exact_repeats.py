"""Operators 6 and 8 against plain versions over sets of seen windows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from grainmill.llm import substring_dedup, suffix_dedup, suffix_tree

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("size", T.StringType()), T.StructField("n", T.LongType())])
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_words(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall((text or "").encode())
        gone = bytearray(len(words))
        own = []
        for p in range(len(words) - length + 1):
            key = tuple(words[p : p + length])
            if key in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(key)
            own.append(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def plain_bytes(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(40)] + ["the", "of"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(None, passage + " tail"), (5, None), (6, ""), (7, "  \n\t "), (8, "short"), (9, "sh " * 400), (10, "x" * 5000), (11, passage)]
    for i in range(12, 40):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 200)))
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + " " + passage[rng.randrange(30) :] + " " + text[at:]
        rows.append((i, text))
    rows += [(50 + k, rows[20][1]) for k in range(5)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == plain_words(rows, 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_strings(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == plain_bytes(rows, 100)


@pytest.mark.parametrize("salt", [2, 5])
def test_hot_groups_are_salted(spark, monkeypatch, salt):
    """Groups above the salting size give the same result."""
    from grainmill.llm import repeats

    monkeypatch.setattr(repeats, "SALT", salt)
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(50)}" for _ in range(80))
    rows = [(i, " ".join(f"a{rng.randrange(90)}" for _ in range(rng.randrange(30))) + " " + passage + f" end{i}") for i in range(60)]
    words = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert words == plain_words(rows, 20)
    data = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert data == plain_bytes(rows, 100)


def test_repeated_rows_do_not_remove_each_other(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (1, "other " * 3)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (1, 0), (2, 60)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in got) == [(1, False), (1, False), (1, False), (2, True)]


def test_empty_tables(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_maximal_repeats():
    """Every reported group is a repeat that cannot be extended to either side, with all its places; none is missing."""
    import numpy as np

    rng = random.Random(4)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 5))]
        data = np.frombuffer(b"".join(strings), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        places, first, lengths = suffix_tree.maximal_repeats(data, offsets, 2)
        got = {strings_at(strings, offsets, p, n): sorted(places[a:b].tolist()) for p, n, a, b in zip(places[first[:-1]], lengths, first[:-1], first[1:])}
        want = {}
        for s, base in zip(strings, offsets):
            for a in range(len(s)):
                for b in range(a + 2, len(s) + 1):
                    want.setdefault(s[a:b], []).append((int(base) + a, s[a - 1] if a else -1 - int(base), s[b] if b < len(s) else -1 - int(base)))
        want = {k: sorted(p for p, _, _ in v) for k, v in want.items() if len(v) > 1 and len({x for _, x, _ in v}) > 1 and len({y for _, _, y in v}) > 1}
        assert {k: v for k, v in got.items() if k in want} == want
        assert all(len(v) > 1 for v in got.values())


def strings_at(strings, offsets, place, n):
    i = max(k for k in range(len(strings)) if offsets[k] <= place)
    return strings[i][place - offsets[i] : place - offsets[i] + n]


@pytest.mark.parametrize(("length", "start"), [(20, 5), (20, 10), (40, 5), (16, 2), (12, 3)])
def test_ladders(spark, length, start):
    """Any number of rungs gives the same result, on texts whose repeats end at every rung."""
    rng = random.Random(length)
    rows = corpus(3) + [(100 + k, " ".join(f"l{(k // 4, i)}".replace(" ", "") for i in range(3 + 3 * (k // 4)))) for k in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows), length=length, start=start).collect()}
    assert got == plain_words(rows, length)


def test_ladders_that_do_not_lead_there(spark):
    for length, start in ((20, 3), (20, 20), (20, 1), (15, 10)):
        with pytest.raises(ValueError, match="first rung"):
            substring_dedup.remove_repeats(frame(spark, []), length=length, start=start)


def test_very_long_texts(spark, monkeypatch):
    """Texts of 40,000 words, one of them twice and one in one line without end; segments in many pieces."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 12)
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(40_000))
    rows = [(1, long), (2, "start " + long + " end"), (3, "y" * 60_000), (4, long[1000:5000]), (5, "tail " * 9000)]
    words = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert words == plain_words(rows, 20)
    data = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert data == plain_bytes(rows, 100)
