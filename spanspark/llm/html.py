"""Main text of web pages by composite text density.

A page becomes a tree without scripts, styles, comments and elements that are something else than the article by their
kind (navigation, footers, asides, forms) or by their whole name (see ``not_article`` and ``named``). The composite text
density of a node is its characters per tag, adjusted for the characters and tags of links; the node with the largest
sum of its children's densities, text runs included, gathers the main text. The article reaches from there towards the
body: an article or main element around it or holding most of it is its border; without one, subtrees beside the way
to the body belong to it if they are as dense as the thinnest node on that way (headings always).

Defined results: null, empty or text-free html gives the empty text; a page without tags is its own text; of equal
sums the outer and earlier node counts; repeated rows give one row each; an empty table gives no rows; very long or
deep pages take time in proportion to their length; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import bound_batches, text_of

# HTML's elements by kind.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
ARTICLE = frozenset(("article", "main"))
NOT_ARTICLE = frozenset("script style noscript template head title nav footer aside form button select input textarea option label iframe object embed svg canvas audio video dialog menu noembed noframes xmp fieldset".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words that name something else than the article, and words that go with them. A class or id counts only if all of its words are of these.
OTHER_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside related recommended header footer masthead topbar toolbar comment comments commentlist disqus respond reply replies share sharing social login signup search widget pagination pager skip".split())
NEUTRAL_NAMES = frozenset("area articles bar block bottom box buttons col column container content form global group holder inner item items left line link links list main media more outer page panel policy post posts primary right row secondary section site slot stories text thread top unit us user with wrap wrapper your".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?+)*+))(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element; parts are its text runs (references decoded) and child elements in page order."""

    __slots__ = ("tag", "parts", "parent", "drop", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent, drop: bool = False, named: bool = False):
        self.tag, self.parent, self.drop, self.named, self.parts = tag, parent, drop, named, []

    def kept(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node) and not p.drop]


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), "".join(values))
    return found


def not_article(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """By kind: elements, hidden ones and roles that are no part of an article (a header outside of one is the site's)."""
    return tag in NOT_ARTICLE or tag == "header" and not inside or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in NOT_ARTICLE_ROLES


def named(tag: str, attributes: dict[str, str]) -> bool:
    """By name: a class or the id says no more than that this is something else ("ad", "cookie-notice"; not "share-prices")."""
    if tag in HEADINGS or tag in ARTICLE or tag in ("html", "body"):
        return False
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in NAME.findall(token)}
        if words & OTHER_NAMES and words <= OTHER_NAMES | NEUTRAL_NAMES:
            return True
    return False


class OpenTags:
    """The way from the root to the open element, and for each tag the depths at which it is open."""

    def __init__(self):
        self.way = [Node("#root", None)]
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]

    def deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)

    def close(self, depth: int) -> None:
        """Closes the element at a depth and all in it."""
        while len(self.way) > depth:
            gone = len(self.way) - 1
            self.depths[self.way.pop().tag].pop()
            if self.blocks[-1] == gone:
                self.blocks.pop()

    def open(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.way))
        if node.tag not in INLINE:
            self.blocks.append(len(self.way))
        self.way.append(node)

    def end(self, tag: str) -> None:
        """An end tag; one of an inline element doesn't reach beyond the block it stands in."""
        depth = self.deepest((tag,))
        if depth and not (tag in INLINE and depth < self.blocks[-1]):
            self.close(depth)

    def imply(self, tag: str) -> None:
        """Closes what the start of a tag ends: a paragraph before a block, an item before the next."""
        if tag in SIBLINGS:
            ends, scope = SIBLINGS[tag], SCOPES.get(tag, ("table",))
        elif tag in CLOSES_P:
            ends, scope = ("p",), ("table", "td", "th", "button")
        else:
            return
        border = self.deepest(scope)
        if tag in ("tr", "thead", "tbody", "tfoot"):
            first = [d[k] for t in ends if (k := bisect_right(d := self.depths[t], border)) < len(d)]
            if first:
                self.close(min(first))
        elif (depth := self.deepest(ends)) > border:
            self.close(depth)


def parse(html: str) -> Node:
    """The tree of a page; what isn't closed is closed where HTML's rules imply it. Linear in the page."""
    tags = OpenTags()
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith("<") or m[0] == "<":
                tags.way[-1].parts.append(unescape(m[0]) if "&" in m[0] else m[0])
            continue
        tag = tag.lower()
        if m[1]:
            tags.end(tag)
            continue
        tags.imply(tag)
        attributes = attributes_of(m[3]) if m[3] else {}
        parent = tags.way[-1]
        child = Node(tag, parent, not_article(tag, attributes, bool(tags.deepest(ARTICLE))), named(tag, attributes))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        if not child.drop or tag not in VOID:
            parent.parts.append(child)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            tags.open(child)
    return tags.way[0]


def walk(root: Node) -> list[Node]:
    """Kept nodes, each before its children."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node) and not p.drop)
    return order


def set_aside(root: Node) -> None:
    """Drops elements named as something else, unless they hold the article's heading or element, or all text there is."""
    order = walk(root)
    holds = {id(root)}
    for x in reversed(order):
        if (x.tag in ARTICLE or x.tag == "h1" or id(x) in holds) and x.parent:
            holds.add(id(x.parent))
    aside = [x for x in order if x.named and id(x) not in holds]
    for x in aside:
        x.drop = True
    if aside and not any(isinstance(p, str) and p.strip() for x in walk(root) for p in x.parts):
        for x in aside:
            x.drop = False


def composite(chars: int, tags: int, link_chars: int, link_tags: int, link_share: float) -> float:
    """Composite text density: characters per tag times a logarithm that falls with the part of links.

    link_share is the body's. One is added to the logarithm's base, so that it is finite on pages without links.
    """
    if not chars:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = 1 + math.log(chars / max(1, chars - link_chars) * link_chars + link_share * chars + math.e)
    return chars / tags * max(0.0, math.log(chars / links * tags / link_tags)) / math.log(base)


def link_share(root: Node) -> float:
    """The part of the body's characters that stand in links, dropped elements included."""
    body, todo = root, [root]
    while todo:
        x = todo.pop()
        if x.tag == "body":
            body = x
            break
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node))
    chars = linked = 0
    inside: list[tuple[Node, bool]] = [(body, body.tag == "a")]
    while inside:
        x, link = inside.pop()
        for p in x.parts:
            if isinstance(p, Node):
                inside.append((p, link or p.tag == "a"))
            else:
                n = len(p.strip())
                chars += n
                linked += n * link
    return linked / max(1, chars)


def densities(root: Node) -> list[Node]:
    """Kept nodes in page order, with their counts, densities and density sums."""
    share, order = link_share(root), walk(root)
    for x in reversed(order):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.sum = 0.0
        for p in x.parts:
            if isinstance(p, str):
                if n := len(p.strip()):
                    x.chars += n
                    x.sum += composite(n, 0, n if x.tag == "a" else 0, 0, share)
            elif not p.drop:
                x.chars += p.chars
                x.tags += 1 + p.tags
                x.link_chars += p.link_chars
                x.link_tags += (p.tag == "a") + p.link_tags
                x.sum += p.density
        if x.tag == "a":
            x.link_chars = x.chars
        x.density = composite(x.chars, x.tags, x.link_chars, x.link_tags, share)
    return order


def main_node(root: Node) -> Node:
    """The node whose kept text is the article's; what beside its way to the body is too thin is marked as dropped."""
    set_aside(root)
    order = densities(root)
    best = max(order, key=lambda x: x.sum)
    way = [best]
    while way[-1].parent and way[-1].tag != "body":
        way.append(way[-1].parent)
    for x in way:
        if x.tag in ARTICLE:
            return x
    inside = max((x for x in walk(best) if x.tag in ARTICLE), key=lambda x: x.sum, default=None)
    if inside and 2 * inside.chars > best.chars:
        return inside
    threshold, on_way = min(x.density for x in way), {id(x) for x in way}
    for x in way[1:]:
        for p in x.kept():
            if id(p) not in on_way and p.tag not in HEADINGS and p.density < threshold:
                p.drop = True
    return way[-1]


def block_text(node: Node) -> str:
    """The node's text: white space turned into one space, blocks joined by one space."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop or x is node:
            gap = [] if x.tag in INLINE else ["\n"]
            todo.extend([*gap, *reversed(x.parts), *gap])
    return " ".join("".join(out).split())


def main_text(html: str) -> str:
    return block_text(main_node(parse(html))) if html.strip() else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = bound_batches(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return own.mapInArrow(texts, "page_id bigint, url string, text string, n_chars bigint")
