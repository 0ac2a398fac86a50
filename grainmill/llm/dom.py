"""A tolerant reader of HTML into slots and text blocks, and simple tree matching between two pages' slots.

Only block-level elements make nodes; inline markup is part of the text around it and a line break is white space.
Siblings of one label (tag, classes, id) in a row share a slot, so that a list is one slot however long it is; numbers
in classes and ids are read as 0. Reading takes time in proportion to the page, however broken it is, and neither
reading nor matching recurses.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_INSIDE = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLANK = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
#: Fixed values of the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
#: Elements that a new one of these ends, up to the boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Slot:
    """A place in the page: a run of siblings of one label."""

    __slots__ = ("label", "kids", "number")

    def __init__(self, label: str):
        self.label, self.kids, self.number = label, [], -1


def _label(tag: str, attributes: str) -> str:
    """tag.class1.class2#id@role, in lower case."""
    out = tag
    if attributes and not attributes.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        for name, mark in (("class", "."), ("id", "#"), ("role", "@")):
            for word in sorted(found.get(name, "").lower().split()):
                out += mark + _DIGITS.sub("0", word)
    return out


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Tags in page order: start, end, '/' for an end tag, name in lower case, attributes; comments and the like have no name.

    A '>' in quotes does not end a tag. Where a quote is never closed, it does from there on; a '<' that nothing ends is text.
    """
    at, quotes = 0, True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        m = _OPEN.match(page, start)
        if not m and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        inside = m.end() if m else start + 2
        end = _INSIDE.match(page, inside).end() if m and quotes else -1
        if m and quotes and page[end : end + 1] != ">":
            quotes = False
        if not (m and quotes):
            end = page.find(">", inside)
        if end < 0:
            return
        at = end + 1
        yield (start, at, m[1], m[2].lower(), page[inside:end]) if m else (start, at, "", "", "")
        if m and not m[1] and m[2].lower() in RAW:
            close = re.compile(rf"</{m[2]}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            yield at, at, "", "", ""


def read(page: str) -> tuple[Slot, list[tuple[Slot, str]]]:
    """The slots of a page and its text blocks, in page order, each with its slot and its text, spaces collapsed."""
    root = Slot("#page")
    stack: list[tuple[str, Slot]] = [("#page", root)]
    is_open: Counter[str] = Counter()
    blocks: list[tuple[Slot, str]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _BLANK.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                blocks.append((stack[-1][1], text))
            held.clear()

    def close(tag: str) -> None:
        done = ""
        while done != tag:
            done = stack.pop()[0]
            is_open[done] -= 1

    at, raw = 0, False
    for start, end, slash, tag, attributes in tags(page):
        if start > at and not raw:
            held.append(page[at:start])
        at, raw = end, False
        if not tag or tag in INLINE:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if slash:
            if is_open[tag]:
                flush()
                close(tag)
            continue
        flush()
        if tag in ENDS_P and is_open["p"]:
            close("p")
        if tag in CLOSES and any(is_open[t] for t in CLOSES[tag][0]):
            ends, stops = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stops:
                    break
                if stack[i][0] in ends:
                    is_open.subtract(t for t, _ in stack[i:])
                    del stack[i:]
                    break
        label, parent = _label(tag, attributes), stack[-1][1]
        if parent.kids and parent.kids[-1].label == label:
            slot = parent.kids[-1]
        else:
            slot = Slot(label)
            parent.kids.append(slot)
        raw = tag in RAW
        if not raw and tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, slot))
            is_open[tag] += 1
    if not raw:
        held.append(page[at:])
    flush()
    return root, blocks


def number(root: Slot) -> list[Slot]:
    """Slots in preorder, numbered."""
    out, todo = [], [root]
    while todo:
        slot = todo.pop()
        slot.number = len(out)
        out.append(slot)
        todo.extend(reversed(slot.kids))
    return out


def skeleton(root: Slot) -> str:
    """The slots as text: labels in preorder with their depth."""
    lines, todo = [], [(root, 0)]
    while todo:
        slot, depth = todo.pop()
        lines.append(f"{depth} {slot.label}")
        todo.extend((k, depth + 1) for k in reversed(slot.kids))
    return "\n".join(lines)


def rebuild(text: str) -> Slot:
    """The slots that skeleton() wrote."""
    path: list[Slot] = []
    for line in text.split("\n"):
        depth, label = line.split(" ", 1)
        slot = Slot(label)
        del path[int(depth) :]
        if path:
            path[-1].kids.append(slot)
        path.append(slot)
    return path[0]


def match(a: Slot, b: Slot) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving, label-equal matching of a's slots to b's, by number."""
    weights: dict[tuple[int, int], tuple[int, list[tuple[Slot, Slot]]]] = {}
    out: dict[int, int] = {}
    if a.label != b.label:
        return out
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if (x.number, y.number) in weights:
            continue
        if not ready:  # the kids first
            todo.append((x, y, True))
            todo.extend((k, q, False) for k in x.kids for q in y.kids if k.label == q.label)
            continue
        m, n = len(x.kids), len(y.kids)
        table = [[0] * (n + 1) for _ in range(m + 1)]
        for i, k in enumerate(x.kids, 1):
            row, above = table[i], table[i - 1]
            for j, q in enumerate(y.kids, 1):
                both = above[j - 1] + weights[k.number, q.number][0] if k.label == q.label else 0
                row[j] = max(above[j], row[j - 1], both)
        pairs, i, j = [], m, n
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x.kids[i], y.kids[j]))
        weights[x.number, y.number] = (table[m][n] + 1, pairs)
    pairs = [(a, b)]
    while pairs:
        x, y = pairs.pop()
        out[x.number] = y.number
        pairs.extend(weights[x.number, y.number][1])
    return out


def merge(tree: Slot, page: Slot) -> None:
    """Adds to the tree the slots of a page that its best matching leaves over, each beside the siblings that it follows."""
    slots = number(tree)
    number(page)
    at = match(page, tree)
    todo = [(page, tree)] if at else []
    while todo:
        x, y = todo.pop()
        place = 0
        for kid in x.kids:
            if kid.number in at:
                target = slots[at[kid.number]]
                place = y.kids.index(target) + 1
                todo.append((kid, target))
            else:
                y.kids.insert(place, kid)
                place += 1
