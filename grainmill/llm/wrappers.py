"""Operator 7: main text of web pages by wrapper induction.

A host's wrapper is the slot trees of all its pages merged into one: of the distinct trees, those of most pages first, each
adds the slots that simple tree matching (dom.py) leaves over. Every page of the host is aligned to it by the same
matching. Over all different pages of the host it is counted how often each slot holds each text; a text that at least
`share` of the pages with the slot have there, and `least` pages or more, is constant: part of the template. Pages of the
same text count once, and a page whose text is constant throughout is left whole. Varying texts, and slots that match
nothing, are content.

What varies is not all content: menus, adverts and footers change from page to page too. So elements that by their tag or
role are no part of the article (NOT_TEXT) are never content, and where a page has an article or main element only what is
within it is. A class or an id is weaker evidence: it shuts an element only if one of its names says what the element is
(not what it has or lacks: 'with-sidebar', 'comments-open'), and never the page's body, an element that holds the article
or main element, or, unless it is the readers' comments, one that holds most of the page's other text. Of an article's own
header the headings are text (its title), the rest is not.

Distinct trees and counts are aggregated with a combiner, a host's trees merged in 64 parts and these into one; wrappers and their constants are one row a host, joined to the pages by host
(broadcast by Spark itself if small, else by shuffling, where a hot host's pages are split like any skewed join).

Broken and deeply nested pages take time in proportion to their size. Nulls: a null or empty html gives an empty text; pages with a null url or no host in it share the host ''. Repeated rows
get the same text. An empty table gives an empty result. Input columns other
than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import materialize

#: Elements that hold no article text.
NOT_TEXT_TAGS = frozenset(
    "nav header footer aside form script style noscript template iframe button select textarea input label dialog object embed canvas svg audio video map head title menu datalist fieldset".split()
)
#: Words in a class, an id or a role that mark what is no article text.
NOT_TEXT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay
    nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget toolbar header masthead footer contentinfo complementary search login signup subscribe newsletter
    comment comments reply replies disqus discussion respond share sharing social related recommended pagination pager""".split()
)
#: Of these, words for what readers write.
COMMENT_WORDS = frozenset("comment comments reply replies disqus discussion respond".split())
#: Words that tell what an element has, lacks or lies beside; a name with one of them says nothing of the element itself.
BESIDE_WORDS = frozenset("with without has have no not is show hide open closed enabled disabled off on offset layout space spacing spacer margin padding below above under after before beside push".split())
_WORD = re.compile(r"[a-z]+|[0-9]+")
_HEADING = re.compile(r"h[1-6]\Z")


@lru_cache(maxsize=100_000)
def facts(label: str) -> tuple[str, bool, str]:
    """Of a label: its tag, whether it is an article or main element, its evidence()."""
    tag = re.match(r"[^.#@]*", label)[0]
    return tag, tag in ("article", "main") or label.endswith("@main"), evidence(label, tag)


def evidence(label: str, tag: str) -> str:
    """What a label says of its element: 'tag' for no text by tag or role, 'comment' or 'class' for no text by a name, '' for nothing."""
    roles = re.findall(r"@([^.#@]*)", label)
    if tag in NOT_TEXT_TAGS or any(w in NOT_TEXT_WORDS for r in roles for w in _WORD.findall(r)):
        return "tag"
    names = [set(_WORD.findall(name)) for name in re.findall(r"[.#]([^.#@]*)", label)]
    said = set().union(*[words for words in names if not words & BESIDE_WORDS]) & NOT_TEXT_WORDS
    return "comment" if said & COMMENT_WORDS else "class" if said else ""


class Page:
    """A page's blocks with the number of their slot; which slots are open to content."""

    def __init__(self, html: str):
        self.root, blocks = dom.read(html)
        slots = dom.number(self.root)
        n = len(slots)
        tags, main, says = zip(*(facts(slot.label) for slot in slots), strict=True)
        shut, article, header = [False] * n, [False] * n, [False] * n
        for slot in slots:  # parents come before their kids
            i = slot.number
            article[i] |= tags[i] == "article"
            if says[i] == "tag" and tags[i] == "header" and article[i]:
                header[i] = True
            elif says[i] == "tag":
                shut[i] = True
            for kid in slot.kids:
                shut[kid.number], article[kid.number], header[kid.number] = shut[i], article[i], header[i]
        for i in range(n):
            shut[i] |= header[i] and not _HEADING.match(tags[i])
        size, holds = [0] * n, [m and not s for m, s in zip(main, shut, strict=True)]
        said = [x == "comment" for x in says]
        for slot in slots:
            for kid in slot.kids:
                said[kid.number] |= said[slot.number]
        for slot, text in blocks:
            if not shut[slot.number] and not said[slot.number]:
                size[slot.number] += len(text)
        for slot in reversed(slots):
            for kid in slot.kids:
                size[slot.number] += size[kid.number]
                holds[slot.number] |= holds[kid.number]
        named, inside = [False] * n, [False] * n
        for slot in slots:
            i = slot.number
            keep = holds[i] or tags[i] in ("html", "body") or (says[i] == "class" and 2 * size[i] > size[0])
            named[i] |= says[i] in ("comment", "class") and not keep
            inside[i] |= main[i] and not shut[i] and not named[i]
            for kid in slot.kids:
                named[kid.number], inside[kid.number] = named[i], inside[i]
        shut = [a or b for a, b in zip(shut, named, strict=True)]
        if any(inside[slot.number] and not shut[slot.number] for slot, _ in blocks):
            shut = [a or not b for a, b in zip(shut, inside, strict=True)]
        self.blocks = [(slot.number, text) for slot, text in blocks]
        self.shut = shut
        self.text = text_hash("\n".join(text for slot, text in self.blocks if not shut[slot]))


class Aligner:
    """Aligns pages to wrappers; pages of one shape are matched once."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], dict[int, int]] = {}

    def __call__(self, page: Page, wrapper: str) -> dict[int, int]:
        key = (dom.skeleton(page.root), wrapper)
        got = self.known.get(key)
        if got is None:
            tree = dom.rebuild(wrapper)
            dom.number(tree)
            if len(self.known) > 5000:
                self.known.clear()
            got = self.known[key] = dom.match(page.root, tree)
        return got


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper, n): the pages' trees and how many pages have them."""
    for batch in batches:
        found = Counter(zip(batch.column("host").to_pylist(), (dom.skeleton(dom.read(x.as_py() or "")[0]) for x in batch.column("html")), strict=True))
        hosts, trees = [h for h, _ in found], [t for _, t in found]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.string()), pa.array(list(found.values()), pa.int64())], ["host", "wrapper", "n"])


def _merged(shapes: pd.DataFrame) -> pd.DataFrame:
    """The trees of one host merged into one, those of most pages first."""
    shapes = shapes.sort_values(["n", "wrapper"], ascending=[False, True])
    tree, *others = map(dom.rebuild, shapes["wrapper"])
    for other in others:
        dom.merge(tree, other)
    return pd.DataFrame({"host": [shapes["host"].iloc[0]], "wrapper": [dom.skeleton(tree)], "n": [shapes["n"].sum()]})


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, text, page): a row with text 0 for each page that has the slot, and one for each text it holds there; page: the hash of its text."""
    align = Aligner()
    for batch in batches:
        hosts, slots, texts, pages = [], [], [], []
        for host, wrapper, html in zip(batch.column("host"), batch.column("wrapper"), batch.column("html"), strict=True):
            page = Page(html.as_py() or "")
            at = align(page, wrapper.as_py())
            seen = {(at[s], text_hash(t)) for s, t in page.blocks if s in at and not page.shut[s]}
            seen |= {(s, 0) for s, _ in seen}
            for slot, text in seen:
                hosts.append(host.as_py())
                slots.append(slot)
                texts.append(text)
                pages.append(page.text)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int32()), pa.array(texts, pa.int64()), pa.array(pages, pa.int64())], ["host", "slot", "text", "page"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    align = Aligner()
    hosts: dict[str, tuple[str, set]] = {}  # a host's wrapper and template, read once
    for batch in batches:
        out = []
        for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)):
            if host not in hosts:
                if len(hosts) > 1000:
                    hosts.clear()
                hosts[host] = batch.column("wrapper")[i].as_py(), {(x["slot"], x["text"]) for x in batch.column("constant")[i].as_py() or ()}
            wrapper, template = hosts[host]
            page = Page(html.as_py() or "")
            at = align(page, wrapper) if template else {}
            blocks = [(s, t) for s, t in page.blocks if not page.shut[s]]
            own = [t for s, t in blocks if not template or (at.get(s), text_hash(t)) not in template]
            out.append("\n".join(own or [t for _, t in blocks]))
        text = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_text(pages: DataFrame, share: float = 0.9, least: int = 3) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    shape = "host string, wrapper string, n long"
    shapes = pages.select("host", "html").mapInArrow(_shapes, shape).groupBy("host", "wrapper").agg(F.sum("n").alias("n"))
    parts = shapes.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(64))).groupBy("host", "part").applyInPandas(lambda x: _merged(x), shape)
    wrappers = materialize(parts.groupBy("host").applyInPandas(lambda x: _merged(x), shape).select("host", "wrapper"), "wrappers")
    seen = pages.join(wrappers, "host").select("host", "wrapper", "html").mapInArrow(_observe, "host string, slot int, text long, page long")
    counts = materialize(seen.distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where(F.col("n") >= least), "texts")
    have = counts.where("text = 0").select("host", "slot", F.col("n").alias("pages"))
    constant = counts.where("text <> 0").join(have, ["host", "slot"]).where(F.col("n") >= share * F.col("pages"))
    constant = constant.groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("constant"))
    known = materialize(wrappers.join(constant, "host", "left"), "wrapped")
    return pages.join(known, "host").select("page_id", "url", "html", "host", "wrapper", "constant").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
