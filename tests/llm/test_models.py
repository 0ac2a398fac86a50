"""Operators 2, 5, 7 and 10 against plain versions, round trips and held-out accuracy."""

import collections
import functools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm import boosting, context_tree, dom, quality, scoring, token_counts, wrappers
from grainmill.llm.blocks import tally

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("score", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOCS).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sentences(n, seed=1):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "the", "mat", "dog", "ran", "été", "x1"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(n)] + [(None, None), (n + 1, ""), (n + 2, " \n\t"), (7, "the cat sat"), (7, "the cat sat")]


# --- language model ---
def test_scores_against_word_counts(spark):
    rows = sentences(120)
    out = scoring.score_documents(frame(spark, rows), common=4).collect()
    assert len(out) == len(rows)
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(t for i, text in rows if not held(i) for t in [*WORD.findall(lower(text)), None])
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, text in rows:
        tokens = [*WORD.findall(lower(text)), None]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        want[i, held(i), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)


def test_held_out_prose_is_predicted_by_contexts(spark, sf_dir):
    """Held-out code length per byte: far under that of bytes without context, trained on the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scoring.score_documents(docs).collect()
    train, bits, n = collections.Counter(), 0.0, 0
    texts = {r.doc_id: "".join(w + " " for w in WORD.findall(lower(r.text))) + "\n" for r in docs.collect()}
    for r in out:
        if not r.held_out:
            train.update(texts[r.doc_id].encode())
    total = sum(train.values())
    for r in out:
        if r.held_out:
            bits -= sum(math.log2((train[b] + 0.5) / (total + 128)) for b in texts[r.doc_id].encode())
            n -= r.score / math.log10(2)
    assert n < 0.65 * bits


def test_no_training_rows_and_empty_table(spark):
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = scoring.score_documents(frame(spark, [(lone, "some words")])).collect()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.score < 0
    assert scoring.score_documents(frame(spark, [])).count() == 0


def plain_log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def plain_tree(text, depth, least):
    """one(context, level, prefix): the probability of a one, node by node from the definition; seen: (context, byte) pairs of the training text."""
    seen = collections.Counter(text)
    of = functools.cache(lambda context: collections.Counter({b: n for b, n in after(context)}))

    def after(context):
        out = collections.Counter()
        for (c, b), n in seen.items():
            if c.endswith(context):
                out[b] += n
        return out.items()

    kept = functools.cache(lambda context: sum(of(context).values()) >= (least if len(context) >= 2 else 1))

    def bits(byte_counts, level, prefix):
        hits = [(b, n) for b, n in byte_counts.items() if b >> (8 - level) == prefix]
        ones = sum(n for b, n in hits if b >> (7 - level) & 1)
        return sum(n for _, n in hits) - ones, ones

    letters = sorted({x for c, _ in seen for x in c})

    @functools.cache
    def weighted(context, level, prefix):
        kt = plain_log_kt(*bits(of(context), level, prefix))
        if len(context) == depth:
            return kt
        below, rest = 0.0, collections.Counter(of(context))
        for x in letters:
            child = bytes([x]) + context
            if kept(child):
                below += weighted(child, level, prefix)
                rest.subtract(of(child))
        below += plain_log_kt(*bits(rest, level, prefix))
        return max(kt, below) + math.log1p(math.exp(-abs(kt - below))) - math.log(2)

    @functools.cache
    def one(context, level, prefix):
        acc, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            c = context[depth - d :]
            if not kept(c):
                break
            a, b = bits(of(c), level, prefix)
            if a + b == 0:
                return last
            own = (b + 0.5) / (a + b + 1)
            w = 1.0 if d == depth else 0.5 * math.exp(plain_log_kt(a, b) - weighted(c, level, prefix))
            acc, left = acc + left * w * own, left * (1 - w)
            last = acc + left * own
        return last

    @functools.cache
    def log10(context, byte):
        p = 0.0
        for level in range(8):
            x = one(context, level, byte >> (8 - level))
            p += math.log10(x if byte >> (7 - level) & 1 else 1 - x)
        return p

    return log10


def test_context_tree_against_recursion():
    """Probabilities of a small tree, node by node, from the definition."""
    text = b"\n\nabracadabra abracadabra\nabba abba\n"
    depth = 2
    codes = [int.from_bytes(text[k : k + depth + 1], "big") for k in range(len(text) - depth)]
    levels = []
    for d in range(depth + 1):
        c, n = tally(np.array([x & ((1 << 8 * (d + 1)) - 1) for x in codes], np.uint64))
        levels.append((c, n.astype(float)))
    tree = context_tree.ContextTree(levels)
    plain = plain_tree([(text[k : k + depth], text[k + depth]) for k in range(len(text) - depth)], depth, 1)
    for context, byte in [(b"ab", ord("r")), (b"ra", ord("c")), (b"zz", ord("a")), (b"br", ord("q"))]:
        got = tree.log10(np.array([int.from_bytes(context, "big") << 8 | byte], np.uint64))[0]
        assert got == pytest.approx(plain(context, byte), abs=1e-5)
    for context in (b"ab", b"zz"):
        every = tree.log10(np.array([int.from_bytes(context, "big") << 8 | x for x in range(256)], np.uint64))
        assert (10 ** every.astype(float)).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize(("least", "per_shard", "most"), [(1, 10**6, 10**6), (3, 10**6, 10**6), (3, 7, 10**6), (3, 10**6, 0)])
def test_scores_against_recursion(spark, least, per_shard, most):
    """The whole way: training, fitting by groups, pruning, shards; each document's score and code length."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Ab", "ra", "cad", "abra", "é"]) for _ in range(rng.randrange(0, 9)))) for i in range(40)] + [(None, None), (99, " \t")]
    depth = 4
    model = lambda t: "".join(w + " " for w in WORD.findall(lower(t))).encode() + b"\n"
    pairs = lambda t: [((b"\n" * depth + t)[k : k + depth], t[k]) for k in range(len(t))]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    plain = plain_tree([x for i, t in rows if not held(i) for x in pairs(model(t))], depth, least)
    out = {r.doc_id: r for r in scoring.score_documents(frame(spark, rows), depth=depth, least=least, per_shard=per_shard, broadcast_grams=most).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        want = sum(plain(c, b) for c, b in pairs(model(t)))
        assert out[i].score == pytest.approx(want, abs=1e-4)
        assert out[i].bits_per_byte == pytest.approx(-want / math.log10(2) / len(model(t)), abs=1e-5)


def test_the_tree_grows_with_the_text(spark):
    """Kept contexts: those seen often enough, however many; the same law for any number of rows."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    sizes = []
    for n in (100, 400):
        rows = [(i, " ".join([word(), word()] * 9)) for i in range(n)]
        counts = scoring.train_counts(frame(spark, rows).withColumn("held_out", F.lit(False)), 4)
        sizes.append(scoring.contexts_of(counts, 4, 8).count())
    assert sizes[1] > 3 * sizes[0]


# --- quality rules ---
def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    cover = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            cover |= set(range(k, k + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(cover), failed


def quality_rows(n=400):
    rng = random.Random(3)
    words = [f"wörd{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = "\n".join(" ".join(rng.choice(words) + ("" if good else "###") for _ in range(12)) for _ in range(rng.randrange(2, 9)))
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_counts_and_held_out_accuracy(spark):
    rows, labels = quality_rows()
    rows += [(1000, "a b c d e f g h i j\n" * 10), (1001, None), (1002, ""), (1003, "one|two < three & four"), (None, "x " * 300), (1001, None)]
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    out = quality.judge_documents(frame(spark, rows), known).collect()
    assert len(out) == len(rows)
    base = collections.Counter((i, *plain_base(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == base
    assert not any(r.kept for r in out if r.base_failed)
    unlabelled = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2 == 0 and not r.base_failed]
    truth = {i: "###" not in (t or "") for i, t in rows}
    assert sum(r.kept == truth[r.doc_id] for r in unlabelled) >= 0.97 * len(unlabelled)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows, _ = quality_rows(40)
    assert all(r.kept != r.base_failed for r in quality.judge_documents(frame(spark, rows), none).collect())
    assert quality.judge_documents(frame(spark, []), none).count() == 0
    kept = quality.judge_documents(frame(spark, rows), none, only_kept=True)
    assert kept.columns == ["doc_id", "text", "kept", "score"]


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * np.sin(20 * x[:, 0]) + 0.2 * rng.normal(size=3000) > 0).astype(float)
    forest = boosting.fit(x, y, np.array([1, -1, 0]))
    for f, way in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((50, 3)), 40, 0)
        grid[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(forest.score(grid).reshape(50, 40), axis=1)
        assert (way * steps >= -1e-9).all()
    assert ((forest.score(x) > 0) == (y > 0)).mean() > 0.8


# --- wrappers ---
def page(host, i, body, extra=""):
    return (i, f"http://{host}/p/{i}", f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy {i}</div>{body}{extra}<footer>&copy; {host} {i}</footer></body></html>")


def test_main_text(spark):
    html = "<article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Four&nbsp;5 &lt;x&gt;</p><script>var a='<p>no</p>'</script><div class='comments'><p>Reader</p></div><aside>side</aside></article>"
    rows = [page("a.org", i, html) for i in range(3)] + [(50, None, None), (51, "", ""), (52, "x", "plain text &amp; more"), (53, "http://b.org/", "<p>a<p>b<div>c<form>no</form></div>d"), (53, "http://b.org/", "<p>a<p>b<div>c<form>no</form></div>d")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    out = wrappers.extract_text(df).collect()
    texts = collections.defaultdict(list)
    for r in out:
        texts[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[0] == ["A & B\nOne two three\nFour 5 <x>"]
    assert (texts[50], texts[51], texts[52], texts[53]) == ([""], [""], ["plain text & more"], ["a\nb\nc\nd"] * 2)
    assert wrappers.extract_text(df.limit(0)).count() == 0


def test_constant_texts_are_template(spark):
    rows = [page("c.org", i, f"<div><h2>Title {i}</h2><p>Body {i} text</p></div><div><p>Follow us everywhere</p></div>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extract_text(df).collect()} == {i: f"Title {i}\nBody {i} text" for i in range(20)}


@pytest.mark.parametrize("first", [None, "", "<html><body><section><h3>Oops</h3></section></body></html>"])
def test_a_strange_first_page_and_two_layouts(spark, first):
    body = lambda i: f"<div><h2>Title {i}</h2><p>Body {i} text</p></div><div><p>Follow us everywhere</p></div>"
    other = lambda i: f"<table><tr><td>Row {i}</td><td>Terms apply</td></tr></table><section><h4>All rights</h4><p>Text {i}</p></section>"
    rows = [(0, "http://c.org/", first)] + [page("c.org", i, body(i)) for i in range(1, 20)] + [page("c.org", i, other(i)) for i in range(20, 40)]
    out = {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Title {i}\nBody {i} text" for i in range(1, 20))
    assert all("All rights" not in out[i] and f"Text {i}" in out[i] and f"Row {i}" in out[i] for i in range(20, 40))


def test_tree_matching():
    a, _ = dom.read("<div><h1>x</h1><p>a</p><ul><li>1</li></ul><p>b</p></div>")
    b, _ = dom.read("<div><p>a</p><table><tr><td>1</td></tr></table><ul><li>1</li><li>2</li></ul></div>")
    na, nb = dom.number(a), dom.number(b)
    pairs = {(na[i].label, nb[j].label) for i, j in dom.match(a, b).items()}
    assert pairs == {("#page", "#page"), ("div", "div"), ("p", "p"), ("ul", "ul"), ("li", "li")}
    assert dom.skeleton(dom.rebuild(dom.skeleton(a))) == dom.skeleton(a)


def weight_by_trying_all(x, y):
    """The size of the largest order-preserving matching of two trees with equal root labels, by trying every way."""

    def best(a, b):
        if not a or not b:
            return 0
        out = max(best(a[1:], b), best(a, b[1:]))
        if a[0].label == b[0].label:
            out = max(out, weight_by_trying_all(a[0], b[0]) + best(a[1:], b[1:]))
        return out

    return 1 + best(x.kids, y.kids)


def test_matching_is_largest():
    rng = random.Random(8)

    def tree(depth):
        slot = dom.Slot(rng.choice("pqr"))
        slot.kids = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return slot

    for _ in range(200):
        a, b = tree(3), tree(3)
        a.label = b.label = "#page"
        na, nb = dom.number(a), dom.number(b)
        got = dom.match(a, b)
        assert len(got) == weight_by_trying_all(a, b)
        assert all(na[i].label == nb[j].label for i, j in got.items())
        assert sorted(got.items()) == sorted(zip(sorted(got), sorted(got.values()), strict=True))  # the order is kept


def extracted(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_names_that_tell_of_something_else(spark):
    """Classes of layouts, states and offsets do not shut what they stand on; those of the element itself do."""
    article = "<h1>Head {i}</h1><p>First {i}</p><p>Second {i}</p>"
    around = [
        ("<body class='with-sidebar home'><article>", "</article></body>"), ("<div class='post has-comments'>", "</div>"), ("<main><div class='page-header-offset'><article>", "</article></div></main>"), ("<main><div class='page-header-offset'>", "</div></main>"),
        ("<div id='sidebar-page-widget'>", "</div>"), ("<article><header><h1>Head {i}</h1><p>by somebody</p></header><p>First {i}</p><p>Second {i}</p>", "<footer>filed</footer></article>"), ("<div class='comments'><article>", "</article></div>"),
    ]
    noise = "<div class='left-sidebar'><p>Side</p></div><div class='comment-list'><p>{c}</p></div><div id='cookie-notice'>Ok?</div><div role='complementary'>more</div>"
    rows = [(i, f"http://h{i}.org/", f"<html>{a}{article if 'Second' not in a else ''}{b}{noise}</html>".replace("{i}", str(i)).replace("{c}", "long comment " * 40)) for i, (a, b) in enumerate(around)]
    assert extracted(spark, rows) == {i: f"Head {i}\nFirst {i}\nSecond {i}" for i in range(len(around))}


def test_small_hosts_copies_and_whole_templates(spark):
    """Three pages are enough to see a template; copies of one page are not three, and a page that is template throughout is left whole."""
    text = lambda i: f"<div><p>Own {i}</p></div><div><p>Follow us</p></div>"
    rows = [page("three.org", i, text(i)) for i in range(3)] + [page("two.org", 10 + i, text(i)) for i in range(2)] + [page("copies.org", 20 + i, text(0)) for i in range(9)]
    out = extracted(spark, rows)
    assert [out[i] for i in range(3)] == ["Own 0", "Own 1", "Own 2"]
    assert [out[i] for i in (10, 11)] == ["Own 0\nFollow us", "Own 1\nFollow us"]
    assert {out[i] for i in range(20, 29)} == {"Own 0\nFollow us"}


def test_deep_long_and_broken_pages(spark):
    """Time in proportion to the page: 5,000 levels, 10 MB of tags that never end, quotes that never close."""
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, "http://a.org/1", deep), (2, "http://a.org/2", deep.replace("deep", "other")), (3, "http://b.org", "<a " * 3_300_000), (4, "http://b.org", "<p>one" + "<i x=\"'>" * 50_000 + "two"), (5, "http://b.org", "</li>" * 200_000 + "<li>" * 2000 + "end")]
    rows += [(6, "http://c.org", "<p>a</p><p class='x>b</p><p>c</p>"), (7, "http://d.org", "5 < 6 <p>and 7 > 6"), (8, "http://e.org", "<p>" + "word " * 1_000_000)]
    began = time.time()
    out = extracted(spark, rows)
    assert time.time() - began < 60
    assert (out[1], out[2], out[5]) == ("deep", "other", "end")
    assert (out[6], out[7], out[8]) == ("a\nb\nc", "5 < 6\nand 7 > 6", ("word " * 1_000_000).strip())
    assert out[4].startswith("one") and out[4].endswith("two")


def plain_extract(rows, share=0.9, least=3):
    """The rule said once more, page by page and in memory."""
    hosts = collections.defaultdict(list)
    for i, url, html in rows:
        hosts[url.split("/")[2]].append((i, wrappers.Page(html)))
    out = {}
    for pages in hosts.values():
        n = collections.Counter(dom.skeleton(p.root) for _, p in pages)
        tree, *others = [dom.rebuild(t) for t in sorted(n, key=lambda t: (-n[t], t))]
        for other in others:
            dom.merge(tree, other)
        dom.number(tree)
        at = {i: dom.match(p.root, tree) for i, p in pages}
        held, have = collections.defaultdict(set), collections.defaultdict(set)
        for i, p in pages:
            whole = tuple(t for s, t in p.blocks if not p.shut[s])
            for s, t in p.blocks:
                if not p.shut[s] and s in at[i]:
                    held[at[i][s], t].add(whole)
                    have[at[i][s]].add(whole)
        constant = {k for k, v in held.items() if len(v) >= least and len(v) >= share * len(have[k[0]])}
        for i, p in pages:
            own = [(at[i].get(s), t) for s, t in p.blocks if not p.shut[s]]
            out[i] = "\n".join([t for s, t in own if (s, t) not in constant] or [t for _, t in own])
    return out


def test_extraction_against_a_plain_version(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice(["red", "green", "blue", "up", "down"]) + str(rng.randrange(40)) for _ in range(n))
    rows, truth = [], {}
    for h in range(12):
        constant = [words(6) for _ in range(4)]
        for k in range(rng.choice([2, 3, 5, 12])):
            i = len(rows)
            own = [words(9) for _ in range(rng.randrange(1, 5))]
            truth[i] = "\n".join(own)
            rest = "".join(f"<section class='s{"abcd"[j]}'><h4>{c}</h4></section>" for j, c in enumerate(constant) if rng.random() < 0.95)
            rows.append((i, f"http://h{h}.org/{i}", f"<html><body class='no-sidebar'><nav>{words(3)}</nav><div>{''.join(f'<p>{t}</p>' for t in own)}</div>{rest}<div class='ad'>{words(4)}</div></body></html>"))
    out = extracted(spark, rows)
    assert out == plain_extract(rows)
    large = [i for i, url, _ in rows if sum(u.split("/")[2] == url.split("/")[2] for _, u, _ in rows) == 12]
    assert large and sum(out[i] == truth[i] for i in large) >= 0.9 * len(large)


# --- token counts ---
def test_token_counts(spark):
    texts = ["One line\nsecond line\n\n\nthird 日本語 line", "", None, "\n\nstarts late", "emoji 😀😀\nxé", "x" * 3000 + "\n" + "word " * 2000]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    encoder, sizes = token_counts.encoding(token_counts.VOCABULARY)
    for rule in ("first", "last", "most"):
        out = token_counts.count_tokens(frame(spark, rows), rule=rule).collect()
        assert len(out) == len(rows)
        for r in out:
            data = (texts[r.doc_id] or "").encode()
            tokens = encoder.encode_ordinary(texts[r.doc_id] or "")
            assert encoder.decode(tokens) == (texts[r.doc_id] or "")
            starts = [k for k in range(len(data)) if k == 0 or (data[k - 1] == 10 and data[k] != 10)]
            want, crossing, at = [0] * len(starts), 0, 0
            for t in tokens:
                lo, hi = at, at + int(sizes[t])
                of = [max(s for s in range(len(starts)) if starts[s] <= k) for k in range(lo, hi)]
                crossing += of[0] != of[-1]
                best = collections.Counter(of)
                want[{"first": of[0], "last": of[-1], "most": min(best, key=lambda s: (-best[s], s))}[rule]] += 1
                at = hi
            assert (r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) == (len(tokens), len(starts), crossing, want)
            assert at == len(data)
    assert token_counts.count_tokens(frame(spark, [])).count() == 0
