"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into block nodes.  Boosted trees rate each node from the
density of its subtree, its tag and attribute words, depth, place and its
siblings.  A decoding over the tree then chooses where main text begins and
where it is left again, once on each way from the root at most, so that no node
is taken inside one that is rejected, nor rejected around one that is taken.

The trees are trained on pages made here: layouts with known main text, drawn
from the usual elements of pages, in invented words.
"""

from __future__ import annotations

import html as _html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship

#: Pages that the trees are trained on.
PAGES = 2000
TREES, DEPTH, RATE, BINS, LEAST = 60, 4, 0.2, 32, 20
#: Pages rated at a time.
BLOCK = 128

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile("[>\"']")
_ATTR = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_GONE = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "head", "svg", "math", "select", "option", "button", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_ENDS_P = _BLOCK - {"caption", "dd", "dt", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "summary"}
#: Start tags that end an open element of these kinds, and the elements that such an end can't cross.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements without text of their own that stand inside a line and don't end its block.
_GONE_INLINE = {"select", "option", "button", "object", "canvas", "audio", "video", "svg", "math", "noscript", "template"}
_SCOPE = {"table", "td", "th", "button", "html", "object", "template", "caption", "noscript"}
#: Attribute words that speak for main text, and those that speak against it.
_FOR = set("article articlebody body content entry main post prose story text".split())
_AGAINST = set(
    "actions ad ads advert advertisement advertorial adverts alert author bar banner breadcrumb breadcrumbs button byline comment comments consent contact cookie cookies copyright "
    "dialog disqus disclaimer dropdown feedback foot footer form gdpr head header hidden login legal links masthead menu meta modal nav navbar navigation newsletter notice notices "
    "notification outbrain overlay pager pagination popup privacy promo promoted promotion recommended related replies reply respond review rss search share sharing shoutbox sidebar "
    "signup skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar tools top trending ugc user warning widget".split()
)
_COMMENTS = {"comment", "comments", "disqus", "replies", "reply", "respond", "shoutbox", "ugc", "discussion", "thread"}
_GROUPS = [{"article", "main"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "menu", "dl"}, {"li", "dt", "dd"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "search"}, {"table", "tbody", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"body", "html"}]


#: Marks main nodes of training pages; no other page has it.
MARK = " data-m\x00"


class Node:
    __slots__ = ("tag", "parent", "kids", "bare", "good", "bad", "talk", "gone", "own", "links", "runs", "order", "marked")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.marked = attributes.endswith(MARK)
        if self.marked:
            attributes = attributes[: -len(MARK)]
        self.kids: list[Node] = []
        self.good = self.bad = self.talk = 0
        self.gone = tag in _GONE or parent is not None and parent.gone
        self.bare = not attributes
        if attributes:
            for m in _ATTR.finditer(attributes):
                name = (m[1] or m[5]).lower()
                value = (m[2] or m[3] or m[4] or "").lower()
                if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.gone = True
                    continue
                if name == "style":
                    continue
                words = set(_WORD.findall(value))
                self.good += len(words & _FOR)
                self.bad += len(words & _AGAINST)
                self.talk += bool(words & _COMMENTS)
        self.own = self.links = 0
        self.runs: list[str] = []  # text blocks directly inside
        self.order: list[int] = []  # their places on the page


def _tag_end(page: str, at: int) -> int:
    """Place of the `>` that ends a tag; -1 if the page ends before.  Quotes that never close count as plain characters."""
    while m := _QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return page.find(">", m.end())
        at = close + 1
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Text, CDATA and tags in order: kind (`text`, `cdata`, `open` or `close`), text or tag name, attributes.

    Comments, declarations and a tag that the page's end cuts off are left out,
    as is what stands in elements of raw text.  Every step moves on, so time
    grows with the page.
    """
    at, end = 0, len(page)
    look = 0
    while (i := page.find("<", look)) >= 0:
        mark = page[i + 1 : i + 2]
        m = _NAME.match(page, i + 1)
        if m is None and mark not in ("!", "?", "/"):
            look = i + 1
            continue
        if i > at:
            yield "text", page[at:i], ""
        if m is not None:
            stop = _tag_end(page, m.end())
            if stop < 0:
                return
            at = stop + 1
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
            elif name in _RAW:
                close = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
                stop = page.find(">", close.start()) if close else -1
                at = stop + 1 if stop >= 0 else end
            else:
                yield "open", name, page[m.end() : stop]
        elif page.startswith("<!--", i):
            stop = page.find("-->", i + 2)
            at = stop + 3 if stop >= 0 else end
        elif page.startswith("<![CDATA[", i):
            stop = page.find("]]>", i + 9)
            yield "cdata", page[i + 9 : stop if stop >= 0 else end], ""
            at = stop + 3 if stop >= 0 else end
        else:
            stop = page.find(">", i)
            at = stop + 1 if stop >= 0 else end
        look = at
    if at < end:
        yield "text", page[at:], ""


@dataclass(slots=True)
class _Open:
    """An open element: its node (the nearest block's for inline ones), and places in the stack of the nearest open `p` within reach and the nearest block."""

    name: str
    node: Node
    p: int
    block: int


def parse(page: str | None) -> list[Node]:
    """Block nodes of a page in order, the root first; each holds its text blocks."""
    root = Node("html", None)
    nodes = [root]
    if not page:
        return nodes
    stack = [_Open("html", root, 0, 0)]
    where: dict[str, list[int]] = {}  # places in the stack of each kind of open element
    owner, inside_link, hidden, place = root, 0, 0, 0
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked, place
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            if text and not owner.gone:
                owner.runs.append(text)
                owner.order.append(place)
                place += 1
                owner.own += len(text)
                owner.links += min(linked, len(text))
            buffer.clear()
            linked = 0

    def push(name: str, node: Node) -> None:
        nonlocal owner, inside_link, hidden
        top, at = stack[-1], len(stack)
        stack.append(_Open(name, node, at if name == "p" else 0 if name in _SCOPE else top.p, at if node is not owner else top.block))
        where.setdefault(name, []).append(at)
        inside_link += name == "a"
        hidden += name in _GONE_INLINE
        owner = node

    def pop(to: int) -> None:
        nonlocal owner, inside_link, hidden
        if stack[-1].block >= to:
            flush()
        for x in stack[to:]:
            where[x.name].pop()
            inside_link -= x.name == "a"
            hidden -= x.name in _GONE_INLINE
        del stack[to:]
        owner = stack[-1].node

    def innermost(names: set[str]) -> int:
        return max([where[x][-1] for x in names if where.get(x)], default=0)

    for kind, tag, attributes in tokens(page):
        if kind in ("text", "cdata"):
            if not hidden:
                buffer.append(tag if kind == "text" else tag.replace("&", "&amp;"))
                if inside_link:
                    linked += len(tag)
        elif kind == "close":
            if tag == "br":
                buffer.append(" ")
            elif where.get(tag):
                i = where[tag][-1]
                if tag in _BLOCK or stack[-1].block <= i:  # an inline end tag doesn't end a block
                    pop(i)
        elif tag in _VOID:
            if tag == "hr":
                if stack[-1].p:
                    pop(stack[-1].p)
                flush()
            elif tag in ("br", "img", "input"):
                buffer.append(" ")
        elif tag == "html" or tag == "body" and where.get("body"):
            root.marked |= attributes.endswith(MARK)
        else:
            if tag in _ENDS_P and stack[-1].p:
                pop(stack[-1].p)
            if tag in _ENDS:
                kinds, walls = _ENDS[tag]
                wall = innermost(walls)
                inside = [w[k] for x in kinds if (w := where.get(x)) and (k := bisect_right(w, wall)) < len(w)]
                if inside:
                    pop(min(inside))
            if tag in _BLOCK or tag in _GONE and tag not in _GONE_INLINE:
                flush()
                node = Node(tag, owner, attributes)
                node.gone |= hidden > 0
                owner.kids.append(node)
                nodes.append(node)
                push(tag, node)
            else:
                push(tag, owner)
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([index[id(x.parent)] if x.parent is not None else 0 for x in nodes])
    own = np.array([0 if x.gone else x.own for x in nodes], float)
    links = np.array([x.links for x in nodes], float)
    blocks = np.array([0 if x.gone else len(x.runs) for x in nodes], float)
    stops = np.array([0 if x.gone else sum(r.count(".") + r.count(",") + r.count("!") + r.count("?") for r in x.runs) for x in nodes], float)
    good, bad, talk = (np.array([getattr(x, a) for x in nodes], float) for a in ("good", "bad", "talk"))
    size, subtext, sublinks, substops, subblocks, longest = np.ones(n), own.copy(), links.copy(), stops.copy(), blocks.copy(), own.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        subtext[p] += subtext[i]
        sublinks[p] += sublinks[i]
        substops[p] += substops[i]
        subblocks[p] += subblocks[i]
        longest[p] = max(longest[p], longest[i])
    depth, abovegood, abovebad, abovetalk, aboveplain = (np.zeros(n) for _ in range(5))
    groups = np.zeros((n, len(_GROUPS)))
    above = np.zeros((n, len(_GROUPS)))
    before = np.zeros(n)
    sofar = 0.0
    for i, x in enumerate(nodes):
        for g, tags in enumerate(_GROUPS):
            if x.tag in tags:
                groups[i, g] = 1
                break
        before[i] = sofar
        sofar += own[i]
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            abovegood[i], abovebad[i], abovetalk[i] = abovegood[p] + good[p], abovebad[p] + bad[p], abovetalk[p] + talk[p]
            above[i] = np.maximum(above[p], groups[p])
    siblings = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
    nth = np.zeros(n)
    count = np.zeros(n)
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        nth[i] = count[parent[i]]
        count[parent[i]] += 1
        same[parent[i], nodes[i].tag] = same.get((parent[i], nodes[i].tag), 0) + 1
    alike = np.array([same.get((parent[i], x.tag), 0) for i, x in enumerate(nodes)], float)
    total = max(subtext[0], 1.0)
    share = lambda a, b: a / np.maximum(b, 1.0)
    cols = [
        depth, np.log1p(size), np.log1p(own), np.log1p(subtext), share(subtext, size), share(sublinks, subtext), share(links, own), share(substops, subtext) * 100, share(subtext, subblocks),
        np.log1p(longest), subtext / total, before / total, share(subtext, subtext[parent]), siblings[parent], share(nth, siblings[parent]), share(alike, siblings[parent]), share(own, subtext),
        share(sublinks[parent], subtext[parent]), np.log1p(subtext[parent]), good, bad, talk, abovegood, abovebad, abovetalk, np.array([x.bare for x in nodes], float),
    ]
    return np.column_stack([*cols, groups, above])


@dataclass
class Forest:
    edges: list[np.ndarray]  # bin edges by feature
    feature: np.ndarray  # trees by inner nodes
    cut: np.ndarray  # highest bin that goes left
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, f[at]] > c[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    """Boosted trees of logistic loss by histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    margin = np.full(len(y), base)
    inner = 2**DEPTH - 1
    all_f, all_c, all_l = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        f, c, leaf = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(inner + 1)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            gs = np.bincount(local, g, width)
            hs = np.bincount(local, h, width)
            for j in range(x.shape[1]):
                key = local * BINS + binned[:, j]
                gl = np.cumsum(np.bincount(key, g, width * BINS).reshape(width, BINS), axis=1)
                hl = np.cumsum(np.bincount(key, h, width * BINS).reshape(width, BINS), axis=1)
                nl = np.cumsum(np.bincount(key, minlength=width * BINS).reshape(width, BINS), axis=1)
                gain = gl**2 / (hl + 1) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + 1) - (gs**2 / (hs + 1))[:, None]
                gain[(nl < LEAST) | (nl[:, -1:] - nl < LEAST)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                f[first : first + width][better] = j
                c[first : first + width][better] = top[better]
            at = 2 * at + 1 + (binned[np.arange(len(y)), f[at]] > c[at])
        local = at - inner
        leaf = RATE * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + 1)
        margin += leaf[local]
        all_f.append(f)
        all_c.append(c)
        all_l.append(leaf)
    return Forest(edges, np.array(all_f), np.array(all_c), np.array(all_l), base)


def decode(nodes: list[Node], margin: np.ndarray) -> np.ndarray:
    """Whether each node is in the main text.

    On each way down, nodes are first outside, then possibly main, then
    possibly left out again.  The choice with the greatest sum of the main
    nodes' margins is taken; a margin counts by the square root of the node's own text.
    """
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    weight = np.array([0.3 + min(x.own, 2500) ** 0.5 / 10 for x in nodes])
    gain = np.clip(margin, -4, 4) * weight
    gain[[x.gone for x in nodes]] = -10
    inside, outside = gain.copy(), np.zeros(n)  # best sums of the subtree if the node is main, or outside
    for i in range(n - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        inside[p] += max(inside[i], 0.0)
        outside[p] += max(outside[i], inside[i])
    state = np.zeros(n, np.int8)  # 0 outside, 1 main, 2 left out
    state[0] = 1 if inside[0] > outside[0] else 0
    for i in range(1, n):
        s = state[index[id(nodes[i].parent)]]
        if s == 0:
            state[i] = 1 if inside[i] > outside[i] else 0
        elif s == 1:
            state[i] = 1 if inside[i] > 0 else 2
        else:
            state[i] = 2
    return state == 1


def main_text(nodes: list[Node], taken: np.ndarray) -> str:
    found = [(k, r) for x, t in zip(nodes, taken, strict=True) if t for k, r in zip(x.order, x.runs, strict=True)]
    return "\n".join(r for _, r in sorted(found))


# ---- training pages -------------------------------------------------------


class _Maker:
    """Draws pages whose main nodes carry `MARK`."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int, dot: bool = True) -> str:
        r = self.r
        n = r.randint(lo, hi)
        out = ["".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.choice((1, 2, 2, 3, 4, 5, 6, 8, 9)))) for _ in range(n)]
        text, k = "", 0
        for w in out:
            text += (w.capitalize() if k == 0 else w) + ("," if dot and r.random() < 0.05 else "")
            k += 1
            if dot and k > 2 and r.random() < 0.12:
                text, k = text + ".", 0
            text += " "
        return text.strip() + ("." if dot and r.random() < 0.9 else "")

    def mark(self, m: bool) -> str:
        return MARK if m else ""

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.25:
            parts = text.split(" ")
            i = r.randrange(len(parts))
            tag = r.choice(("b", "i", "em", "strong", 'a href="/x"', "span", "code"))
            parts[i] = f"<{tag}>{parts[i]}</{tag.split(' ')[0]}>"
            text = " ".join(parts)
        return text

    def paragraph(self, m: bool, lo: int = 3, hi: int = 120) -> str:
        r = self.r
        text = self.inline(self.words(lo, r.choice((lo + 8, hi, hi))))
        if r.random() < 0.1:
            text = f"<b>{text}<br>"
            return f"<p{self.mark(m)}>{text}"
        return f"<p{self.mark(m)}>{text}" + ("</p>" if r.random() < 0.95 else "")

    def links(self, lo: int, hi: int) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.words(1, 3, False)}</a>' for i in range(r.randint(lo, hi))]
        form = r.random()
        if form < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if form < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def attr(self, choices: str, p: float = 0.85) -> str:
        r = self.r
        if r.random() > p:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{r.choice(choices.split())}"'

    def box(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return f"<nav{self.attr('menu navbar top-nav', 0.4)}>{self.links(3, 9)}</nav>" if r.random() < 0.6 else f"<div{self.attr('menu nav navigation main-menu breadcrumbs top-bar')}>{self.links(3, 9)}</div>"
        if kind == "header":
            inner = (f"<h1>{self.words(1, 4, False)}</h1>" if r.random() < 0.4 else f"<div>{self.words(1, 5, False)}</div>") + (f"<p>{self.words(2, 9)}</p>" if r.random() < 0.5 else "") + (self.box("nav") if r.random() < 0.4 else "")
            return f"<header{self.attr('site-header masthead', 0.4)}>{inner}</header>" if r.random() < 0.7 else f"<div{self.attr('header masthead site-head', 0.95)}>{inner}</div>"
        if kind == "footer":
            inner = r.choice((f"&copy; {self.words(1, 4, False)} &middot; {self.words(4, 30)}", f"<p>{self.words(3, 30)}</p>", self.links(2, 6), f"<p>{self.words(3, 12)}</p>{self.links(2, 5)}"))
            return f"<footer{self.attr('footer site-footer', 0.3)}>{inner}</footer>" if r.random() < 0.75 else f"<div{self.attr('footer legal copyright', 0.95)}>{inner}</div>"
        if kind == "aside":
            inner = "".join(r.choice((f"<h3>{self.words(1, 4, False)}</h3>{self.links(2, 6)}", f"<p>{self.words(4, 40)}</p>", f"<div>{self.words(4, 25)}</div>")) for _ in range(r.randint(1, 3)))
            return f"<aside{self.attr('sidebar widget', 0.4)}>{inner}</aside>" if r.random() < 0.5 else f"<div{self.attr('sidebar side-bar widget widgets related recommended trending', 0.95)}>{inner}</div>"
        if kind == "ad":
            return f"<{(t := r.choice(('div', 'div', 'section', 'p')))}{self.attr('ad ads advert banner promo sponsored ad-box advertisement', 0.97)}>{r.choice((self.words(2, 25), f'<p>{self.words(3, 30)}</p>' if t != 'p' else self.words(3, 30)))}</{t}>"
        if kind == "notice":
            return f"<div{self.attr('cookie-notice notice cookie-banner consent gdpr alert popup modal newsletter-signup privacy-notice', 0.97)}>{r.choice((self.words(5, 40), f'<p>{self.words(5, 40)}</p>'))}<button>{self.words(1, 2, False)}</button></div>"
        if kind == "form":
            fields = "".join(f"<label>{self.words(1, 3, False)}</label><input name=a>" for _ in range(r.randint(1, 4)))
            return f"<form{self.attr('search login newsletter subscribe comment-form', 0.5)}><p>{self.words(2, 12)}</p>{fields}<button>{self.words(1, 2, False)}</button></form>"
        if kind == "share":
            return f"<div{self.attr('share social tags share-tools post-meta byline author', 0.95)}>{r.choice((self.links(2, 5), self.words(1, 8, False)))}</div>"
        if kind == "script":
            return r.choice(('<script>var t="</p>";x(1);</script>', "<style>p{margin:0}</style>", "<noscript><p>x</p></noscript>", "<!-- x -->"))
        one = lambda: r.choice((f"<p>{self.words(3, 60)}</p>", f"<div>{self.words(3, 60)}</div>", f"<p>{self.words(1, 3, False)}</p><p>{self.words(4, 60)}</p>"))
        items = [f"<{(t := r.choice(('div', 'li', 'div', 'article')))}{self.attr('comment comment-body reply post-comment', 0.8)}>{one()}</{t}>" for _ in range(r.randint(1, 6))]
        head = f"<h{(k := r.choice((2, 3, 4)))}>{self.words(1, 3, False)}</h{k}>" if r.random() < 0.6 else ""
        tag = r.choice(("div", "section", "section", "aside", "ol", "div"))
        return f"<{tag}{self.attr('comments comment-list replies discussion disqus responses reader-comments user-comments', 0.97)}>{head}{''.join(items)}</{tag}>"

    def article(self) -> str:
        r = self.r
        parts = [f"<h1{self.mark(True)}>{self.words(2, 14, r.random() < 0.3)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            k = r.random()
            if k < 0.78:
                parts.append(self.paragraph(True))
            elif k < 0.86:
                parts.append(f"<h{(h := r.choice((2, 3)))}{self.mark(True)}>{self.words(1, 8, False)}</h{h}>")
            elif k < 0.91:
                tag = r.choice(("ul", "ol"))
                parts.append(f"<{tag}{self.mark(True)}>" + "".join(f"<li{self.mark(True)}>{self.words(2, 25)}" + r.choice(("", "</li>")) for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif k < 0.95:
                parts.append(f"<blockquote{self.mark(True)}>{self.paragraph(True)}</blockquote>")
            else:
                rows = "".join(f"<tr{self.mark(True)}>" + "".join(f"<td{self.mark(True)}>{self.words(1, 5, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4)))
                parts.append(f"<table{self.mark(True)}>{rows}</table>")
        for kind, p in (("ad", 0.2), ("share", 0.25), ("notice", 0.06), ("form", 0.06), ("script", 0.1), ("aside", 0.08)):
            if r.random() < p:
                parts.insert(r.randint(0, len(parts)), self.box(kind))
        if r.random() < 0.12:
            parts.append(self.box("comments"))
        if r.random() < 0.08:
            parts.insert(0, f"<header><p>{self.words(2, 6)}</p></header>")
        if r.random() < 0.08:
            parts.append(f"<footer>{self.words(3, 12)}</footer>")
        body = "".join(parts)
        k = r.random()
        if k < 0.5:
            return f"<article{self.attr('post entry story hentry', 0.3)}{self.mark(True)}>{body}</article>"
        if k < 0.65:
            return f"<main{self.attr('main content', 0.3)}{self.mark(True)}>{body}</main>"
        return f"<div{self.attr('content article post entry-content story-body main post-body text', 0.85)}{self.mark(True)}>{body}</div>"

    def blocks(self, least: int = 1) -> str:
        """Main blocks without an element around them."""
        r = self.r
        parts = [f"<h{(h := r.choice((1, 2, 2, 3)))}{self.mark(True)}>{self.words(1, 10, False)}</h{h}>"] if r.random() < 0.5 else []
        return "".join(parts + [self.paragraph(True) for _ in range(r.choice((least, least, 2, 3, 6)))])

    def running(self) -> str:
        """Text without elements around its paragraphs."""
        r = self.r
        return r.choice(("<br><br>", "<br>", " ", "\n\n")).join(self.inline(self.words(6, 120)) for _ in range(r.choice((1, 1, 2, 4))))

    def plain_article(self) -> str:
        """Main text in nested, tabular or no elements."""
        r = self.r
        k = r.random()
        if k < 0.3:
            inner = r.choice((self.blocks, self.running))()
            head = f"<h{(h := r.choice((1, 2, 3)))}{self.mark(True)}>{self.words(1, 9, False)}</h{h}>" if r.random() < 0.7 else ""
            return f"<div{self.attr('content main page-content wrapper article', 0.7)}{self.mark(True)}>{head}<div{self.attr('text body inner copy content col', 0.7)}{self.mark(True)}>{inner}</div></div>"
        if k < 0.45:
            return f"<main{self.mark(True)}>" + "".join(f"<section{self.mark(True)}>{self.blocks()}</section>" for _ in range(r.randint(1, 4))) + "</main>"
        if k < 0.75:
            main = f"<td{self.mark(True)}>{r.choice((self.blocks, self.running))()}</td>"
            side = f"<td{self.attr('side nav menu left', 0.4)}>{self.links(2, 8)}</td>"
            cells = [main] if r.random() < 0.4 else r.sample([main, side], 2)
            top = f"<tr><td>{self.box('nav') if r.random() < 0.5 else self.words(1, 5, False)}</td></tr>" if r.random() < 0.3 else ""
            return f"<table{self.attr('layout', 0.2)}>{top}<tr>{''.join(cells)}</tr></table>"
        tag = r.choice(("div", "article", "section", "main"))
        return f"<{tag}{self.mark(True)}>{r.choice((self.blocks, self.running))()}</{tag}>"

    def bare_page(self) -> str:
        """A page or fragment that holds little but its text."""
        r = self.r
        k = r.random()
        if k < 0.25:
            return f"<html{MARK}>{self.running()}"
        if k < 0.5:
            return r.choice((f"<html{MARK}>", "")) + self.blocks()
        inner = self.plain_article() if k < 0.75 else r.choice((self.blocks, self.running))()
        extra = "".join(self.box(kind) for kind in ("nav", "footer", "ad") if r.random() < 0.25)
        return f"<html><head><title>{self.words(1, 6)}</title></head><body{self.mark(k >= 0.75)}>{inner}{extra}</body></html>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return self.bare_page()
        parts = [self.article() if r.random() < 0.75 else self.plain_article()]
        for kind, p, front in (("nav", 0.85, 0.9), ("header", 0.5, 1.0), ("ad", 0.6, 0.6), ("notice", 0.35, 0.6), ("aside", 0.45, 0.4), ("form", 0.25, 0.5), ("share", 0.2, 0.4), ("comments", 0.4, 0.0), ("script", 0.4, 0.5), ("footer", 0.85, 0.0)):
            if r.random() < p:
                parts.insert(0 if r.random() < front else len(parts), self.box(kind))
        body = "".join(parts)
        if r.random() < 0.3:
            body = f"<div{self.attr('page wrapper container site', 0.8)}>{body}</div>"
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{body}{end}"


@lru_cache(maxsize=2)
def train(pages: int = PAGES, seed: int = 11) -> Forest:
    maker = _Maker(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        nodes = parse(maker.page())
        xs.append(features(nodes))
        ys.append(np.array([x.marked for x in nodes]))
        ws.append(np.array([0.5 + min(x.own, 400) / 200 for x in nodes]))
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def extract_block(pages: list[str | None], forest: Forest) -> list[str]:
    trees = [parse(p) for p in pages]
    margins = forest.margin(np.concatenate([features(t) for t in trees])) if trees else np.zeros(0)
    out, at = [], 0
    for t in trees:
        out.append(main_text(t, decode(t, margins[at : at + len(t)])))
        at += len(t)
    return out


def extract(df: DataFrame, html: str = "html", into: str = "main_text", forest: Forest | None = None) -> DataFrame:
    """Add ``into``: the main text of each whole page, blocks joined by line ends.

    Character references are decoded, white space inside a block becomes one
    space, ends are trimmed.  Null, empty and markup-only pages give an empty
    text; broken markup is read as far as it goes; pages of any length are read
    whole; repeated rows give equal texts; an empty table stays empty; other
    columns are kept and ``into`` gets underscores if the name is taken.
    """
    ship(df.sparkSession)
    forest = forest or train()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), BLOCK):
                out += extract_block(batch.slice(at, BLOCK).to_pylist(), forest)
            yield pa.array(out, pa.string())

    return df.withColumn(fresh(df, into), run.asNondeterministic()(F.col(html)))
