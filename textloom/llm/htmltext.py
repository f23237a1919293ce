"""Main text of HTML pages by composite text density.

A page is parsed into a tree with implied end tags. For every node but those that hold no text to read (scripts, styles and
so on) a composite density is computed: characters per tag, adjusted by the share of linked characters and link tags; tags
that only format a phrase within a block, line breaks included, are not counted. The densities of a node's children are
summed; the node with the largest sum is the core of the page. The page itself, or a wrapper of nine tenths of its
characters, gives way to the child whose sum reaches half its own, as short articles have few children to sum. The smallest
sum on the path from the core to the body is the threshold: beside that path each subtree with a node whose sum reaches it
gives the one of the largest sum. No tag marks the core: pages give the same text with <article> renamed, and nearly all do
with menus, headers, footers and so on as plain <div> without classes.

Elements that are never main text (menus, forms, notices, adverts, comments and so on, by tag, role or class words) count
for the densities, but are no core, and are left out of what the core holds.

A pass without a shuffle; a page is one row, and its tree the only state. Parsing takes time in proportion to the page,
broken ones included: open elements are found by their tag, not by walking up the tree.
Edge cases: null and empty pages give an empty text; broken markup is read leniently and never fails; repeated rows are
read one by one; other columns pass through, those named as the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import frugal

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that format a phrase; they split no block and do not thin its text.
PHRASE = set("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag ends the open elements of the second set, up to one of the third.
CLOSES = {x: ({"p"}, {"table", "td", "th", "button", "body"}) for x in BLOCK - {"body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}}
CLOSES |= {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "body"}), "dt": ({"dt", "dd", "p"}, {"dl", "body"}), "dd": ({"dt", "dd", "p"}, {"dl", "body"}),
    "tr": ({"tr"}, {"table", "body"}), "td": ({"td", "th"}, {"tr", "table", "body"}), "th": ({"td", "th"}, {"tr", "table", "body"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table", "body"}), "thead": ({"tbody", "thead", "tfoot"}, {"table", "body"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table", "body"}), "option": ({"option"}, {"select", "body"}),
}
DROPPED = set("head title script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog menu xmp noembed noframes audio video map".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promotion promotions sidebar sidebars menu menus nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription share sharing social related recommended recommendations comment comments commentlist disqus replies respond "
    "pagination pager toolbar login signup skip widget widgets".split()
)
#: Elements without text to read.
MUTE = set("head title script style noscript template textarea iframe object svg canvas xmp noembed noframes audio video map select button".split())
KEPT = {"html", "body", "main", "article"}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "children", "drop", "chars", "links", "tags", "link_tags", "density", "total", "parent", "holds", "place")

    def __init__(self, tag: str, parent: Node | None, drop: bool, place: int = 0):
        self.tag, self.parent, self.drop, self.place = tag, parent, drop, place
        self.children: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.holds = False  # an article, main or h1 below


def dropped(tag: str, attributes: str) -> bool:
    """Never main text, by its tag, role, class and id words, or as hidden."""
    if tag in DROPPED:
        return True
    if not attributes or tag in KEPT:
        return False
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    named = f"{found.get('class', '')} {found.get('id', '')}"
    words = re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()
    return not WORDS.isdisjoint(re.findall("[a-z]+", words))


class Open:
    """The open elements, and for each tag the places of those that have it."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.kept: list[int] = [0]

    def nearest(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in KEPT:
            self.kept.append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        for node in self.stack[place:]:
            self.places[node.tag].pop()
            if node.tag in KEPT:
                self.kept.pop()
        del self.stack[place:]


def parse(html: str) -> Node:
    root = Node("html", None, False)
    open_ = Open(root)
    stack = open_.stack
    at, n = 0, html.rfind(">") + 1  # what follows is text, but for a comment that is never closed
    while at < n:
        m = TOKEN.search(html, at, n)
        end = m.start() if m else n
        if end > at:
            stack[-1].children.append(html[at:end])
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            place = open_.nearest((tag,))
            if place and (tag in KEPT or tag in BLOCK or place > open_.kept[-1]):
                open_.cut(place)
            continue
        if tag == "html" or tag == "body" and open_.nearest(("body",)):
            continue
        if tag == "body":
            open_.cut(1)
        if rule := CLOSES.get(tag):
            place = open_.nearest(rule[0])
            if place > open_.nearest(rule[1]):
                open_.cut(place)
        node = Node(tag, stack[-1], dropped(tag, attributes), at)
        stack[-1].children.append(node)
        if tag in ("article", "main", "h1"):
            above: Node | None = stack[-1]
            while above is not None and not above.holds:
                above.holds, above = True, above.parent
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            continue
        if tag in RAW:  # text up to its own end tag
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at, n)
            node.children.append(html[at : stop.start() if stop else n])
            at = stop.end() if stop else len(html)
            continue
        open_.push(node)
    rest = html[max(at, n) :].split("<!--", 1)[0]
    if rest:
        stack[-1].children.append(rest)
    return root


def _below(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and c.tag not in MUTE]


def _measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes with text to read, bottom up; returned: the nodes, parents first."""
    order, todo = [], [(root, False)]
    linked: dict[int, bool] = {}
    while todo:
        node, link = todo.pop()
        order.append(node)
        linked[id(node)] = link = link or node.tag == "a"
        todo += [(c, link) for c in _below(node)]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                size = len("".join(c.split()))
                node.chars += size
                node.links += size if linked[id(node)] else 0
            elif c.tag not in MUTE:
                node.chars += c.chars
                node.links += c.links
                node.tags += c.tags + (c.tag not in PHRASE)
                node.link_tags += c.link_tags + (c.tag == "a")
    body = root
    for node in reversed(order):
        c, lc, t, lt = node.chars, node.links, max(1, node.tags), max(1, node.link_tags)
        if c > 1:
            base = math.log(c / max(1, c - lc) * lc + body.links / max(1, body.chars) * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / max(base, 1.0)
        node.total = sum(x.density for x in _below(node) if x.tag not in PHRASE)
    return order


def left_out(node: Node) -> bool:
    return node.drop and (not node.holds or node.tag in DROPPED)


def core(root: Node) -> list[Node]:
    """Roots of the subtrees that hold the main text, in page order."""
    order = _measure(root)
    out: set[int] = set()  # what the lists leave out, and all below
    for node in order:
        if left_out(node) or node.parent is not None and id(node.parent) in out:
            out.add(id(node))
    of_sum = lambda x: x.total
    fit = lambda nodes: [x for x in nodes if id(x) not in out]
    best = max(fit(order), key=of_sum)  # of equal sums the one nearest to the root
    page: Node | None = root
    while page is not None:
        if page is best:
            inner = max(fit(_below(best)), key=of_sum, default=None)
            if inner is None or not inner.total or 2 * inner.total < best.total:
                break
            best = inner
        page = next((c for c in fit(_below(page)) if c.tag == "body" or c.chars >= 0.9 * page.chars), None)
    threshold, node = math.inf, best.parent
    path = {id(best)}
    while node is not None:
        path.add(id(node))
        threshold, node = min(threshold, node.total or math.inf), node.parent
    top: dict[int, Node] = {}
    for node in reversed(order):
        if id(node) not in out:
            top[id(node)] = max([node, *(top[id(c)] for c in fit(_below(node)))], key=of_sum)
    roots, todo = [best], [root]
    while todo:
        node = todo.pop()
        if node is best:
            continue
        if id(node) in path:
            todo += fit(_below(node))
        elif top[id(node)].total >= threshold:
            roots.append(top[id(node)])
    return sorted(roots, key=lambda x: x.place)


def blocks_of(root: Node) -> list[str]:
    """Texts of the blocks of a subtree, in page order, white space squeezed."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", unescape("".join(part))).strip():
            out.append(text)
        part.clear()

    todo: list[Node | str | None] = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif x is root or not left_out(x):
            if x.tag in ("br", "wbr"):
                part.append(" " if x.tag == "br" else "")
                continue
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    return "\n\n".join(t for node in core(root) for t in blocks_of(node))


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Adds the main text and its number of code points; the page itself is not carried on."""
    kept = pages.drop(text, n_chars) if html not in (text, n_chars) else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html)
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(x for x in batch.schema.names if x != html), text, n_chars])

    fields = [f for f in kept.schema.fields if f.name != html]
    return kept.mapInArrow(frugal(run), StructType([*fields, StructField(text, StringType()), StructField(n_chars, LongType())]))
