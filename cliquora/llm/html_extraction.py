"""HTML extraction: gradient-boosted trees over DOM-node features, decoded over the tree.

A page becomes a tree of block elements with their text in blocks. Each node has features: its tag and those above it, tokens of
its attributes and of those above, subtree density (text, links, tags, paragraphs), depth and sibling statistics. Boosted trees
give the odds that a node belongs to the main text. Decoding finds the best consistent choice for the whole tree: a node is
above the main text, in it, or out; under an outer node all is out, under a main node only main or out can be.

The trees are fitted on TRAINING_PAGES generated pages whose parts are known (articles amid menus, headers, footers, sidebars,
notices, adverts, forms, comments); the generator is seeded, so that every run has the same model.

Where the trees choose nothing but text stands right in the body, that text and the body's own paragraphs are the main text (a
page without any box). Ties in the decoding go to the outer part. Keys named text, n_chars or html_ would clash and are the caller's
to name; other columns are not read. Null and empty pages have empty text. Unclosed, misnested and cut-off markup is closed where the next block starts or the page
ends; a head ends at the first tag that can't be in it, a hidden paragraph, item or cell where the next one starts or what it is in
ends, and of other hidden or dropped elements without an end tag only the start tag goes (of script, style, textarea and title the
rest of the page). Very long pages are parsed in one pass. Repeated rows give equal texts. An empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES, TREES, DEPTH, BINS, RATE = 1200, 60, 4, 32, 0.2
MAX_TOKENS = 120
#: Fitted on generated pages that the trees have not seen.
LEAVE = 1.0

#: Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("script style head title template svg noscript iframe object canvas audio video select textarea button".split())
RAW = set("script style textarea title".split())
CLOSES = {"p": set("p".split()), "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: What may be in a head, and what is closed without an end tag.
IN_HEAD = set("base link meta title style script noscript template".split())
IMPLIED = set("p li dt dd tr td th".split())
TAGS = "html body article main section div p h1 h2 h3 ul ol li nav header footer aside form table td blockquote pre figure dl".split()
ABOVE_TAGS = "article main section nav header footer aside form ul table blockquote".split()

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: An attribute's name and value; values are stepped over whole.
NAMED = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...]
    place: int  # among its siblings
    chars: int = 0
    links: int = 0
    tags: int = 0
    commas: int = 0
    paragraphs: int = 0
    items: int = 0
    own: int = 0  # characters of its own blocks
    before: int = 0  # characters before it in the page
    children: int = 0
    kinds: dict = field(default_factory=dict)


def paired(page: str, tag: str) -> dict[int, int]:
    """Where each start tag of this name begins -> where its end tag ends, over elements of the same name within. Unclosed ones are not there."""
    found, opened = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?![\w-])[^>]*>", page, re.I):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def is_hidden(attributes: str) -> bool:
    """Whether an attribute says so: hidden, a style without display, or aria-hidden. What stands in other values doesn't count."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for name, value in NAMED.findall(low):
        value = value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.strip() == "true") or (name == "style" and NOT_SHOWN.search(value)):
            return True
    return False


def raw_end(page: str, at: int, tag: str) -> int:
    e = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*>", re.I).search(page, at)
    return e.end() if e else len(page)


def head_end(page: str, at: int) -> int:
    """Where the head ends whose content begins here: after its end tag, or before the first text or tag that can't be in it."""
    pairs: dict[str, dict[int, int]] = {}
    while at < len(page):
        m = TOKEN.match(page, at)
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].strip() and not (m[0][0] == "<" and len(m[0]) > 1):
                return at
        elif m[1] or m[4]:
            if tag in ("head", "body", "html"):
                return m.end() if tag == "head" else at
        elif tag == "head":
            pass
        elif tag not in IN_HEAD:
            return at
        elif tag in RAW:
            at = raw_end(page, m.end(), tag)
            continue
        elif tag in DROPPED:
            if tag not in pairs:
                pairs[tag] = paired(page, tag)
            at = pairs[tag].get(at, m.end())
            continue
        at = m.end()
    return at


def implied_end(page: str, at: int, tag: str, around: set[str]) -> int:
    """Where a paragraph, item or cell ends whose content begins here, with its end tag or without; around: the elements it is in."""
    inner: list[str] = []
    while at < len(page):
        m = TOKEN.match(page, at)
        name = (m[2] or m[5] or "").lower()
        if not name:
            pass
        elif m[1] or m[4]:
            if name in inner:
                while inner.pop() != name:
                    pass
            elif name == tag:
                return m.end()
            elif name in around and name not in INLINE:
                return at
        elif tag == "p" and name not in INLINE and name not in DROPPED and all(t in INLINE for t in inner):
            return at
        elif tag in CLOSES.get(name, ()) and tag != "p" and not any(t in SCOPES[name] for t in inner):
            return at
        elif tag in ("tr", "td", "th") and name in ("tbody", "thead", "tfoot") and "table" not in inner:
            return at
        elif name in RAW:
            at = raw_end(page, m.end(), name)
            continue
        elif name not in VOID:
            inner.append(name)
        at = m.end()
    return at


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order (0 is the root), and the blocks: (node, text with single spaces)."""
    nodes = [Node("html", -1, 0, (), 0)]
    blocks: list[tuple[int, str]] = []
    # open elements: (tag, node), of inline ones the node around them
    stack: list[tuple[str, int]] = [("html", 0)]
    # where blocks stand in it, how many of each name are open, and of each block the inline elements that are open within it
    places: list[int] = [0]
    open_blocks: Counter[str] = Counter()
    open_inline: list[Counter[str]] = [Counter()]
    parts: list[str] = []
    pairs: dict[str, dict[int, int]] = {}
    linked, total, at, end = 0, 0, 0, len(page)

    def cut(i: int) -> None:
        """Closes all from place i on."""
        for name, _ in reversed(stack[i:]):
            if name in INLINE:
                open_inline[-1][name] -= 1
            else:
                open_inline.pop()
                places.pop()
                open_blocks[name] -= 1
        del stack[i:]

    def flush() -> None:
        nonlocal total, linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                node = nodes[stack[-1][1]]
                blocks.append((stack[-1][1], text))
                node.own += len(text)
                node.links += min(linked, len(text))
                node.commas += text.count(",") + text.count(".")
                total += len(text)
        linked = 0

    match = TOKEN.match
    while at < end:
        m = match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue  # a comment or a declaration
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if any(t == "a" for t, _ in stack[-3:]):
                linked += len(text.strip())
            continue
        tag = tag.lower()
        if m[0][-1] != ">":
            break  # cut off within a tag
        if m[1] or m[4]:  # an end tag
            if open_inline[-1][tag] if tag in INLINE else open_blocks[tag]:
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if tag not in INLINE or stack[i][1] != stack[-1][1]:
                    flush()
                cut(i)
            continue
        attributes = m[3] if m[2] else m[6]
        nodes[stack[-1][1]].tags += 1
        if tag in DROPPED or is_hidden(attributes):
            if tag in VOID:
                continue
            # all of it goes: up to its end tag, or up to where it ends without one; of others that are never closed the start tag
            if tag == "head":
                at = head_end(page, at)
            elif tag in RAW:
                at = raw_end(page, at, tag)
            elif tag in IMPLIED:
                at = implied_end(page, at, tag, {t for t, _ in stack})
            else:
                if tag not in pairs:
                    pairs[tag] = paired(page, tag)
                at = pairs[tag].get(m.start(), at)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID:
                stack.append((tag, stack[-1][1]))
                open_inline[-1][tag] += 1
            continue
        flush()
        if tag == "html":
            continue
        # a block ends the paragraph around it; items and cells end those of the same list or table
        ends = {"p", *CLOSES.get(tag, ())}
        for i in reversed(places[1:]) if any(open_blocks[name] for name in ends) else ():
            name = stack[i][0]
            if name in ends:
                cut(i)
                if name != "p" or tag not in SCOPES:
                    break
            elif tag not in SCOPES or name in SCOPES[tag]:
                break
        if tag in VOID:
            continue
        parent = stack[-1][1]
        up = nodes[parent]
        up.kinds[tag] = up.kinds.get(tag, 0) + 1
        tokens = tuple(sorted({t for a in ATTRIBUTE.findall(attributes) for t in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a.strip("\"'")).lower())})) if attributes else ()
        places.append(len(stack))
        open_blocks[tag] += 1
        open_inline.append(Counter())
        stack.append((tag, len(nodes)))
        nodes.append(Node(tag, parent, up.depth + 1, tokens, up.children, before=total))
        up.children += 1
    flush()
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        n.chars += n.own
        if i:
            up = nodes[n.parent]
            up.chars += n.chars
            up.links += n.links
            up.tags += n.tags + 1
            up.commas += n.commas
            up.paragraphs += n.paragraphs + (n.tag == "p")
            up.items += n.items + (n.tag == "li")
    return nodes, blocks


def feature_rows(nodes: list[Node], vocabulary: dict[str, int]) -> np.ndarray:
    """A row a node. The root's row counts like others."""
    out = np.zeros((len(nodes), 16 + len(TAGS) + len(ABOVE_TAGS) + 2 * len(vocabulary)), np.float32)
    whole = max(1, nodes[0].chars)
    base, above_at, own_at = 16, 16 + len(TAGS), 16 + len(TAGS) + len(ABOVE_TAGS)
    up_at = own_at + len(vocabulary)
    tag_at = {t: i for i, t in enumerate(TAGS)}
    above = {t: i for i, t in enumerate(ABOVE_TAGS)}
    for i, n in enumerate(nodes):
        row = out[i]
        up = nodes[n.parent] if i else n
        chars = n.chars
        row[:16] = (
            n.depth, math.log1p(chars), math.log1p(n.own), n.links / max(1, chars), n.tags / max(1, chars), n.commas / max(1, chars), n.paragraphs, n.items,
            chars / whole, n.before / whole, n.place, up.children, up.kinds.get(n.tag, 0), chars / max(1, up.chars), up.links / max(1, up.chars), up.paragraphs,
        )
        if n.tag in tag_at:
            row[base + tag_at[n.tag]] = 1
        if i:
            row[above_at:own_at] = out[n.parent, above_at:own_at]
            row[up_at:] = np.maximum(out[n.parent, up_at:], out[n.parent, own_at:up_at])
            if up.tag in above:
                row[above_at + above[up.tag]] = 1
        for t in n.tokens:
            k = vocabulary.get(t)
            if k is not None:
                row[own_at + k] = 1
    return out


@dataclass
class Trees:
    """Complete trees of one depth: in each inner node a feature and a threshold, in each leaf a value."""

    start: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss with histograms."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    cuts = [np.array([0.0]) if len(c) == 1 and c[0] in (0, 1) else c for c in cuts]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    f = np.full(len(y), start)
    used = [j for j in range(x.shape[1]) if binned[:, j].max(initial=0) > 0]
    trees = []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        feature, threshold, leaf = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(2**DEPTH)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            own = at - first
            best, G, H = np.zeros(width), np.bincount(own, g, width), np.bincount(own, h, width)
            base = G * G / (H + ridge)
            for j in used:
                n = len(cuts[j]) + 1
                key = own * n + binned[:, j]
                gl = np.bincount(key, g, width * n).reshape(width, n).cumsum(1)[:, :-1]
                hl = np.bincount(key, h, width * n).reshape(width, n).cumsum(1)[:, :-1]
                gr, hr = G[:, None] - gl, H[:, None] - hl
                gain = np.where((hl > least) & (hr > least), gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - base[:, None], 0)
                k = gain.argmax(1)
                value = gain[np.arange(width), k]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[first : first + width][better] = j
                threshold[first : first + width][better] = cuts[j][k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        own = at - (2**DEPTH - 1)
        leaf = RATE * np.bincount(own, g, 2**DEPTH) / (np.bincount(own, h, 2**DEPTH) + ridge)
        f += leaf[own]
        trees.append((feature, threshold, leaf))
    return Trees(start, *(np.array(t) for t in zip(*trees, strict=True)))


def decode(nodes: list[Node], odds, leave: float = LEAVE) -> list[bool]:
    """True for the nodes in the main text, under the best consistent choice. leave: what an outer node under a main one costs."""
    n = len(nodes)
    inside, outside = [0.0] * n, [0.0] * n
    for i in range(n):
        o = odds[i]
        inside[i], outside[i] = -math.log1p(math.exp(-o)) if o > -30 else o, -math.log1p(math.exp(o)) if o < 30 else -o
    # sums over the subtree: all out; main with what is best below; above it with what is best below
    out, main, above = outside[:], inside[:], outside[:]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        out[p] += out[i]
        main[p] += max(main[i], out[i] - leave)
        above[p] += max(main[i], above[i], out[i])
    state = ["above"] + [""] * (n - 1)
    if main[0] > above[0]:
        state[0] = "main"
    for i in range(1, n):
        up = state[nodes[i].parent]
        if up == "out":
            state[i] = "out"
        elif up == "main":
            state[i] = "main" if main[i] > out[i] - leave else "out"
        else:
            state[i] = "main" if main[i] > max(above[i], out[i]) else "above" if above[i] > out[i] else "out"
    return [s == "main" for s in state]


# Generated pages.

WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tu", "sa", "vor", "pel", "di", "qua", "est", "ing", "on", "ba") for b in ("", "n", "ta", "ri", "lon", "mes", "de", "stor", "vi", "ble")]
MAIN_BOX = ["article", "main", "section class=article", "div class=content", "div class=post-body", "div id=main-content", "div class=entry-content", "div class=story", "article class=post", "div class=article-text"]
JUNK = {
    "nav": ["nav", "div class=nav", "ul class=menu", "div id=navigation", "nav class=breadcrumb", "div class=navbar", "div class=breadcrumbs", "nav class=pagination"],
    "header": ["header", "div id=header", "div class=masthead", "div class=site-header", "header class=top"],
    "footer": ["footer", "div id=footer", "div class=site-footer", "footer class=copyright"],
    "side": ["aside", "div class=sidebar", "div class=related", "aside class=widget", "div id=sidebar", "section class=recommended", "div class=promo"],
    "notice": ["div class=cookie", "div class=cookie-notice", "div id=consent", "div class=banner", "div class=notice", "div role=alert", "div class=gdpr", "div class=newsletter-popup"],
    "ad": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "ins class=adsbygoogle", "div id=ad-top", "section class=ad-slot"],
    "form": ["form", "form class=search", "form id=subscribe", "div class=newsletter", "form class=login"],
    "comments": ["section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div class=comments-area", "section id=reader-comments"],
    "share": ["div class=share", "div class=social", "ul class=share-buttons", "div class=tags"],
}


class Writer:
    """Writes a page and remembers which of its block elements are main text (in the order of their start tags)."""

    def __init__(self, seed: int):
        self.r, self.html, self.main = random.Random(seed), [], []

    def text(self, low: int, high: int) -> str:
        own = [self.r.choice(WORDS) for _ in range(self.r.randint(low, high))]
        for i in range(len(own)):
            if self.r.random() < 0.12:
                own[i] += self.r.choice([",", ".", ".", "!", " &amp;"])
        return " ".join(own).capitalize() + self.r.choice([".", ".", ""])

    def inline(self, low: int, high: int) -> str:
        t = self.text(low, high)
        x = self.r.random()
        if x < 0.15:
            t += f' <a href="/{self.r.choice(WORDS)}">{self.text(1, 3)}</a> {self.text(2, 9)}'
        elif x < 0.3:
            t = f"<b>{t}" + self.r.choice(["</b>", "<br>", "", "</b><br>"])
        elif x < 0.4:
            t = f"<em>{self.text(1, 4)}</em> {t}"
        return t

    def open(self, spec: str, main: bool) -> str:
        tag, *attributes = spec.split(" ")
        self.html.append("<" + " ".join([tag, *(re.sub("=(.*)", r'="\1"', a) for a in attributes)]) + ">")
        if tag not in INLINE:
            self.main.append(main)
        return tag

    def close(self, tag: str, always: bool = False) -> None:
        if always or tag not in ("p", "li") or self.r.random() < 0.9:
            self.html.append(f"</{tag}>")

    def block(self, spec: str, text: str, main: bool) -> None:
        tag = self.open(spec, main)
        self.html.append(text)
        self.close(tag)

    def links(self, n: int, main: bool = False) -> None:
        tag = self.open(self.r.choice(["ul", "ul", "ol"]), main)
        for _ in range(n):
            self.block("li", f'<a href="/{self.r.choice(WORDS)}">{self.text(1, 4)}</a>', main)
        self.close(tag, True)

    def junk(self, kind: str) -> None:
        r = self.r
        tag = self.open(r.choice(JUNK[kind]), False)
        if kind in ("nav", "share", "header") or kind == "footer" and r.random() < 0.4:
            if kind == "header" and r.random() < 0.6:
                self.block(r.choice(["h1", "div class=logo", "p"]), self.text(1, 4), False)
            if r.random() < 0.75 and tag not in ("ul", "ol"):
                self.links(r.randint(2, 8))
            else:
                self.html.append(" ".join(f'<a href="/{r.choice(WORDS)}">{self.text(1, 2)}</a>' for _ in range(r.randint(2, 7))))
        if kind == "footer":
            t = f"&copy; {self.text(1, 3)} &middot; {self.text(3, 14)}"
            self.block("p", t, False) if r.random() < 0.5 else self.html.append(t)
        if kind in ("ad", "notice"):
            t = self.text(3, 16 if kind == "ad" else 30)
            self.block(r.choice(["p", "div", "span"]), t, False) if r.random() < 0.4 else self.html.append(t)
        if kind == "form":
            self.html.append(f'<label>{self.text(1, 3)}</label> <input name="q"> {self.text(2, 10)}')
            if r.random() < 0.5:
                self.block("p", self.text(3, 14), False)
        if kind == "side":
            self.block(r.choice(["h2", "h3", "h4"]), self.text(1, 4), False)
            self.links(r.randint(2, 6)) if r.random() < 0.6 else [self.block("p", self.text(5, 40), False) for _ in range(r.randint(1, 3))]
        if kind == "comments":
            if tag != "ol":
                self.block("h3", self.text(1, 3), False)
            for _ in range(r.randint(1, 5)):
                inner = self.open("li" if tag == "ol" else r.choice(["div class=comment", "article class=comment", "div"]), False)
                for _ in range(r.randint(1, 3)):
                    self.block("p", self.text(4, 70), False)
                self.close(inner, True)
        self.close(tag, True)

    def article(self) -> None:
        r = self.r
        tag = self.open(r.choice(MAIN_BOX), True)
        if r.random() < 0.85:
            self.block("h1", self.text(2, 11), True)
        wrapped = self.open("div", True) if r.random() < 0.2 else None
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.78:
                self.block("p", self.inline(*r.choice([(1, 6), (3, 14), (5, 30), (20, 120), (60, 200)])), True)
            elif x < 0.84:
                self.block(r.choice(["h2", "h3"]), self.text(1, 7), True)
            elif x < 0.88:
                inner = self.open(r.choice(["ul", "ol"]), True)
                for _ in range(r.randint(2, 6)):
                    self.block("li", self.inline(3, 25), True)
                self.close(inner, True)
            elif x < 0.9:
                self.block(r.choice(["blockquote", "pre"]), self.text(5, 50), True)
            elif x < 0.91:
                inner = self.open("table", True)
                for _ in range(r.randint(1, 4)):
                    row = self.open("tr", True)
                    for _ in range(3):
                        self.block("td", self.text(1, 5), True)
                    self.close(row, True)
                self.close(inner, True)
            else:
                self.junk(r.choice(["ad", "ad", "share", "side", "form", "notice"]))
        if wrapped:
            self.close(wrapped, True)
        if r.random() < 0.12:
            self.junk(r.choice(["comments", "share", "side"]))
        self.close(tag, True)

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        self.html.append(f'<!DOCTYPE html><html lang="en"><head><title>{self.text(2, 8)}</title><style>p{{margin:0}}</style></head>')
        self.open("body", False)
        wrap = self.open(r.choice(["div id=wrapper", "div class=container", "div"]), False) if r.random() < 0.3 else None
        for kind, p in (("notice", 0.25), ("header", 0.45), ("nav", 0.75), ("ad", 0.5), ("form", 0.15)):
            if r.random() < p:
                self.junk(kind)
        if r.random() < 0.2:
            self.junk("side")
        self.article()
        for kind, p in (("comments", 0.3), ("side", 0.3), ("share", 0.15), ("ad", 0.25), ("form", 0.2), ("nav", 0.1), ("footer", 0.85), ("notice", 0.1)):
            if r.random() < p:
                self.junk(kind)
        if wrap:
            self.close(wrap, True)
        self.html.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.html), self.main


@dataclass
class Model:
    vocabulary: dict[str, int]
    trees: Trees

    def extract_many(self, pages: list[str]) -> list[str]:
        parsed = [parse(p) for p in pages]
        rows = [feature_rows(nodes, self.vocabulary) for nodes, _ in parsed]
        odds = self.trees.odds(np.concatenate(rows)).tolist() if rows else []
        out, at = [], 0
        for nodes, blocks in parsed:
            main = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            if not any(main[node] for node, _ in blocks):
                # nothing is in a box that looks like main text: what stands right in the body is
                main = [n.tag == "body" or not i or n.tag == "p" and nodes[n.parent].tag in ("body", "html") for i, n in enumerate(nodes)]
                if not any(main[node] and nodes[node].tag != "p" for node, _ in blocks):
                    main = [False] * len(nodes)
            out.append("\n".join(text for node, text in blocks if main[node]))
        return out


@lru_cache(maxsize=2)
def train(n_pages: int = TRAINING_PAGES, seed: int = 0) -> Model:
    """The model depends on the generator alone, never on a table: one driver fits it once."""
    pages = [Writer(seed + i).page() for i in range(n_pages)]
    parsed = [(parse(p)[0], main) for p, main in pages]
    seen: dict[str, int] = {}
    for nodes, _ in parsed:
        for n in nodes:
            for t in n.tokens:
                seen[t] = seen.get(t, 0) + 1
    vocabulary = {t: i for i, t in enumerate(sorted(sorted(seen), key=lambda t: -seen[t])[:MAX_TOKENS])}
    x, y = [], []
    for nodes, main in parsed:
        if len(nodes) != len(main) + 1:
            raise AssertionError("a generated page was parsed into other nodes")
        x.append(feature_rows(nodes, vocabulary))
        y += [False, *main]
    return Model(vocabulary, boost(np.concatenate(x), np.array(y, float)))


def extract_main_text(pages: DataFrame, model: Model, keys=("page_id", "url"), column: str = "html") -> DataFrame:
    """The keys, text and n_chars of every row."""
    keys = list(keys)

    def extracted(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = model.extract_many([x.as_py() or "" for x in part.column("html_")])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, F.col(column).alias("html_")).mapInArrow(extracted, f"{kinds}, text string, n_chars long")
