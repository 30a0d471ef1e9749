"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block-level element is a node that is content or not. A node's potential comes from its tag,
its class and id words and its own text (length, share in links, sentence marks); a potential on
each edge ties a child to its parent. One upward and one downward sum-product pass give every
node's exact content marginal; blocks of text whose node is likelier content than not are kept.

All potentials are smoothed counts over labelled pages: the layouts of ``html_pages``, in which every
element of the article is marked by hand.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelyard.llm.common import map_batches
from pixelyard.llm.html_pages import labelled

#: Elements of HTML by how a parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements without text of the page, left out whole; one that its page doesn't close is an ordinary element.
ASIDE = frozenset("svg select template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var object".split())
#: Their tags are passed over too, and their text stays in its block.
INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr semantics annotation annotation-xml".split())
INLINE |= frozenset("svg g path circle rect line polyline polygon ellipse use defs symbol text tspan image lineargradient radialgradient stop clippath mask pattern filter foreignobject".split())
#: HTML start tags that end an open svg, but inside the elements that may hold HTML.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = frozenset("foreignobject desc title".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag of the key closes an open element of the value, up to the nearest list or table.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"}}
#: Elements that hold text or a list; the others divide a page. An edge's potential is its child's kind's.
HOLDERS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote table thead tbody tr td th ul ol dl dt dd figcaption caption center address".split())
FENCE = frozenset("ul ol dl menu table body html article section div".split())

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: The last '/' of a tag that belongs to the value of an attribute without quotes.
_UNQUOTED_END = re.compile(r"=\s*[^\s\"']*/\Z")
_PART = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.!?;:,]")


@dataclass
class Page:
    """Nodes in page order: each one's parent, tag, names; and the text blocks, each with its node."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    names: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    """(node, text, characters of it in links)"""
    marked: list[bool] = field(default_factory=lambda: [False])
    """labelled as the article's"""


def _empty(attributes: str) -> bool:
    """Whether a tag closes itself, as those of svg and math may."""
    return attributes.endswith("/") and _UNQUOTED_END.search(attributes) is None


def _raw_end(source: str, name: str, pos: int) -> re.Match[str] | None:
    return re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(source, pos)


def _ends(source: str, first: re.Match[str], ends: dict[int, int | None]) -> None:
    """Where the ``ASIDE`` element of a start tag ends, by the tag's end; None if nothing closes it.

    Elements of the same name that are met on the way are settled too, so no part of a page is read again
    for each of them.
    """
    name = first[2].lower()
    opened, inside, pos = [first.end()], 0, first.end()
    ends[first.end()] = None
    while opened and (m := _TAG.search(source, pos)) is not None:
        pos = m.end()
        tag = (m[2] or "").lower()
        if tag == name:
            if m[1]:
                ends[opened.pop()] = pos
            elif name == "select":  # a second one ends the first, which its page didn't close
                return
            elif not (name == "svg" and _empty(m[3])):
                ends[pos] = None
                opened.append(pos)
        elif name == "svg":
            if tag in HTML_INSIDE and not _empty(m[3]):
                inside = max(0, inside + (-1 if m[1] else 1))
            elif tag in BREAKOUT and not m[1] and not inside:
                return
        elif not m[1] and name == "select" and tag in ("input", "textarea"):
            return
        elif not m[1] and tag in RAW and (close := _raw_end(source, tag, pos)):
            pos = close.end()


def parse(source: str) -> Page:
    """The block-level tree of a page; unclosed, misnested and cut-off markup is taken as browsers roughly do."""
    page = Page()
    stack, at, node, in_link = ["#root"], [0], 0, 0
    opened: defaultdict[str, list[int]] = defaultdict(list)  # the depths of the open elements of a name
    fences: list[int] = []
    parts: list[str] = []
    linked = 0
    ends: dict[int, int | None] = {}
    endless: set[str] = set()  # elements that nothing closes from here on

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.blocks.append((node, text, min(linked, len(text))))
            parts = []
        linked = 0

    def leave(depth: int) -> None:
        nonlocal node
        flush()
        for name in stack[depth:]:
            opened[name].pop()
            if name in FENCE:
                fences.pop()
        del stack[depth:], at[depth:]
        node = at[-1]

    pos, end = 0, len(source)
    while pos < end:
        m = _TAG.search(source, pos)
        if m is None:
            parts.append(source[pos:])
            break
        if m.start() > pos:
            parts.append(source[pos : m.start()])
            linked += (m.start() - pos) * bool(in_link)
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = 0
            if name in INLINE or name in VOID:
                if name == "br":
                    parts.append(" ")
                continue
            if opened[name]:
                leave(opened[name][-1])
            elif name == "p":
                flush()
            continue
        if name in RAW:
            close = None if name in endless else _raw_end(source, name, pos)
            if close is None:
                endless.add(name)
            if close or name in ("textarea", "script", "style", "title"):
                pos = close.end() if close else end
            continue
        if name in ASIDE and not (name == "svg" and _empty(m[3])):
            if pos not in ends:
                _ends(source, m, ends)
            if ends[pos] is not None:
                pos = ends[pos]
                continue
        if name in INLINE:
            if name == "a":
                in_link = 1
            elif name in ("mtd", "annotation", "annotation-xml"):
                parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr"):
                parts.append(" " if name == "br" else "")
            continue
        if name in ENDS_P and opened["p"]:
            leave(opened["p"][-1])
        elif name in CLOSES:
            fence = fences[-1] if fences else 0
            inside = [open_[i] for x in CLOSES[name] if (open_ := opened[x]) and (i := bisect_right(open_, fence)) < len(open_)]
            if inside:
                leave(min(inside))
        flush()
        if name in ("html", "body") and opened[name]:
            continue
        names = frozenset(p for x in _NAMES.finditer(m[3]) for p in _PART.findall((x[1] or x[2] or x[3] or "").lower())) if m[3] and "=" in m[3] else frozenset()
        page.parent.append(node)
        page.tag.append(name)
        page.names.append(names)
        page.marked.append("data-k" in m[3])
        node = len(page.tag) - 1
        opened[name].append(len(stack))
        if name in FENCE:
            fences.append(len(stack))
        stack.append(name)
        at.append(node)
    flush()
    if "body" not in page.tag:  # it may be left out
        page.tag[0] = "body"
    return page


def _observed(page: Page) -> list[list[tuple[str, str]]]:
    """What is seen at each node: pairs of kind and value."""
    chars, links, marks = [0] * len(page.tag), [0] * len(page.tag), [False] * len(page.tag)
    for node, text, linked in page.blocks:
        chars[node] += len(text)
        links[node] += linked
        if not marks[node]:
            marks[node] = _MARKS.search(text) is not None
    out = []
    for i, tag in enumerate(page.tag):
        n = chars[i]
        seen = [("tag", tag + ", named" * bool(page.names[i]) + ", with text" * bool(n))] + [("name", x) for x in page.names[i]]
        if n:
            share = links[i] / n
            length = "short" if n < 25 else "line" if n < 90 else "some" if n < 250 else "long"
            seen.append(("text", f"{length}, {'no' if not links[i] else 'few' if share < 0.4 else 'most'} links, {'with' if marks[i] else 'no'} marks"))
        out.append(seen)
    return out


@dataclass
class Model:
    """Log potentials: for what is seen, content less other; for edges, by (parent, child) labels."""

    seen: dict[tuple[str, str], float]
    edge: tuple[tuple[tuple[float, float], tuple[float, float]], ...]
    """for children that divide and for those that hold"""
    root: float

    def marginals(self, page: Page) -> list[float]:
        """Each node's probability of being content, by sum-product over the tree."""
        n, get = len(page.tag), self.seen.get
        own = [sum(get(x, 0.0) for x in seen) for seen in _observed(page)]
        edge = [tuple(math.exp(x) for row in e for x in row) for e in self.edge]
        kinds = [edge[tag in HOLDERS] for tag in page.tag]
        own[0] += self.root
        # messages and beliefs are log ratios of content to other
        up, below = [0.0] * n, own[:]
        for i in range(n - 1, 0, -1):
            e00, e01, e10, e11 = kinds[i]
            b = math.exp(max(-300.0, min(300.0, below[i])))
            up[i] = math.log((e10 + e11 * b) / (e00 + e01 * b))
            below[page.parent[i]] += up[i]
        belief = below[:]
        for i in range(1, n):
            e00, e01, e10, e11 = kinds[i]
            rest = math.exp(max(-300.0, min(300.0, belief[page.parent[i]] - up[i])))
            belief[i] = below[i] + math.log((e01 + e11 * rest) / (e00 + e10 * rest))
        return [1.0 / (1.0 + math.exp(-max(-300.0, min(300.0, x)))) for x in belief]


def train(pages: Iterable[str], smooth: float = 0.5) -> Model:
    """Potentials from pages in which ``data-k`` marks the elements whose own text is the article's.

    A node with text of its own is content if it is marked. One without is content if there is content
    below it and it isn't above the smallest node that holds all of the page's content, or if there is
    no other text below it.
    """
    counts: dict[str, dict[str, list[float]]] = defaultdict(lambda: defaultdict(lambda: [smooth, smooth]))
    edges, nodes = [[[smooth, smooth], [smooth, smooth]] for _ in range(2)], [smooth, smooth]  # nodes: the roots
    for source in pages:
        page = parse(source)
        good, bad = [0] * len(page.tag), [0] * len(page.tag)
        for node, text, _ in page.blocks:
            (good if page.marked[node] else bad)[node] += len(text)
        below, other = good[:], bad[:]
        for i in range(len(page.tag) - 1, 0, -1):
            below[page.parent[i]] += below[i]
            other[page.parent[i]] += other[i]
        label = [0] * len(page.tag)
        whole = max((i for i in range(len(page.tag)) if below[i] == below[0]), default=0)  # nodes are in page order: the last is the lowest
        for i in range(len(page.tag)):
            own = good[i] + bad[i]
            label[i] = int(good[i] > bad[i]) if own else int(below[i] > 0 and (i >= whole or not other[i]))
        nodes[label[0]] += 1
        for i, seen in enumerate(_observed(page)):
            for kind, value in seen:
                counts[kind][value][label[i]] += 1
            if i:
                edges[page.tag[i] in HOLDERS][label[page.parent[i]]][label[i]] += 1
    seen = {}
    for kind, values in counts.items():
        total = [sum(v[k] for v in values.values()) for k in (0, 1)]
        for value, v in values.items():
            if kind == "name":  # its absence says nothing: a layout seldom names its parts in the same words
                seen[kind, value] = math.log(v[1] / v[0])
            else:
                seen[kind, value] = math.log(v[1] / total[1]) - math.log(v[0] / total[0])
    edge = tuple(tuple(tuple(math.log(x / sum(row)) for x in row) for row in e) for e in edges)
    return Model(seen, edge, math.log(nodes[1] / nodes[0]))


def main_text(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parse(source)
    if not page.blocks:
        return ""
    marginal = model.marginals(page)
    return "\n\n".join(text for node, text, _ in page.blocks if marginal[node] > 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``.

    ``text`` holds the content blocks in page order, parted by an empty line; ``n_chars`` its code
    points. Closed svg, select and template elements have no text of the page; math and the fallback of
    object have. A null or empty page, or one without content, has an empty text. Markup that ends early is
    read as far as it goes. Repeated rows give repeated rows; an empty table gives no rows; other columns
    are ignored.
    """
    known = train(labelled()) if model is None else model

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, known) for x in batch["html"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
