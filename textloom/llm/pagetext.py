"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded from the top down.

Pages become trees of block elements. Every node gets features of its subtree's density, its
attributes' tokens, its depth, its siblings and its ancestors; boosted trees give the odds that
its text belongs to the article. Decoding picks, for each subtree, all, nothing, or a split among
its children, whichever explains all its nodes best, so that no node contradicts an ancestor that
was taken or dropped as a whole. The trees are trained on generated pages (``pagegen``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that a step takes together, in characters of html.
STEP_CHARS = 4_000_000
#: Log-odds that a split of a subtree costs.
SPLIT = -1.5

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)"""
    r"""|(script|style|iframe|textarea|title|xmp|noembed|noframes)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|(/?)([a-z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*|[^>]*)>"""
    r"""|[!?/][^>]*>)""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMING = frozenset("class id role itemprop aria-label name".split())
#: Characters of a start tag's attributes that are remembered; longer ones are read each time.
KEPT_ATTRIBUTES = 400
_SUBWORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

# HTML's inline elements, void elements, and elements that a start tag closes.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture video audio source track map area img object canvas math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mpadded mphantom menclose mstyle merror semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose content is no text of the page; those that a block's start tag ends, where their own end is missing.
_MUTE, _MUTE_TO_BLOCK = frozenset("svg select template annotation annotation-xml".split()), frozenset("svg select".split())
#: Elements that features tell apart.
_TAGS = "article main section div p h nav header footer aside form list li table cell quote figure other".split()
_TAG_OF = {"ul": "list", "ol": "list", "menu": "list", "dl": "list", "dt": "li", "dd": "li", "tr": "table", "tbody": "table", "thead": "table", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "fieldset": "form", "button": "form", "dialog": "aside", **{f"h{i}": "h" for i in range(1, 7)}}
#: Groups of attribute tokens that features tell apart.
TOKENS = {
    "main": "article content contents main body entry post story text prose page maincontent articlebody richtext copy",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toolbar pager pagination toc skip",
    "head": "header head masthead topbar top branding logo hero banner site",
    "foot": "footer foot bottom copyright legal colophon credits",
    "side": "sidebar side aside rail complementary widget widgets related recommended popular trending more secondary tags archive",
    "ad": "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion commercial dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog banner disclaimer warning message toast",
    "form": "form newsletter subscribe signup login search input contact survey poll email",
    "comment": "comment comments commentlist reply replies respond discussion discuss disqus review reviews reader feedback thread",
    "share": "share sharing social facebook twitter follow like buttons print byline author meta date tag",
}
_GROUP_OF: dict[str, int] = {}
for _i, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        _GROUP_OF[_w] = _GROUP_OF.get(_w, 0) | 1 << _i
_N_GROUPS = len(TOKENS)


def _kind(tag: str, attributes: str) -> tuple[int, int]:
    """(number among _TAGS, bits of the token groups) of a start tag."""
    groups = _GROUP_OF["notice"] if tag == "noscript" else 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in _NAMING:
            for w in _SUBWORD.findall(max(values, key=len)):
                groups |= _GROUP_OF.get(w.lower(), 0)
    return _TAG_NUMBER.get(_TAG_OF.get(tag, tag), _TAG_NUMBER["other"]), groups


@lru_cache(maxsize=50_000)
def _kept_kind(tag: str, attributes: str) -> tuple[int, int]:
    return _kind(tag, attributes)
_TAG_NUMBER = {t: i for i, t in enumerate(_TAGS)}


@dataclass
class Trees:
    """Block elements of many pages, parents before children; a page's root is its own parent."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)  # in the page's head
    chars: list[int] = field(default_factory=list)  # own text
    linked: list[int] = field(default_factory=list)  # of it, in links
    stops: list[int] = field(default_factory=list)  # punctuation in own text
    inputs: list[int] = field(default_factory=list)
    items: list[tuple[int, str]] = field(default_factory=list)  # (node, block of text), in page order

    def _node(self, parent: int, tag: str, attributes: str, page: int) -> int:
        i = len(self.parent)
        kind, groups = (_kept_kind if len(attributes) <= KEPT_ATTRIBUTES else _kind)(tag, attributes)
        self.parent.append(i if parent < 0 else parent)
        self.depth.append(0 if parent < 0 else self.depth[parent] + 1)
        self.tag.append(kind)
        self.groups.append(groups)
        self.page.append(page)
        self.hidden.append(tag == "head" or parent >= 0 and self.hidden[parent])
        for x in (self.chars, self.linked, self.stops, self.inputs):
            x.append(0)
        return i

    def add(self, html: str, page: int) -> None:
        """Parse one page: unclosed and misnested elements as browsers do, in outline, in time that follows its length."""
        root = self._node(-1, "html", "", page)
        names, nodes = ["html"], [root]
        open_at: dict[str, list[int]] = {}  # places of the open elements of each name
        text: list[str] = []
        links = 0
        linked = 0
        muted, inner = "", 0

        def flush():
            nonlocal linked
            if text:
                block = " ".join(unescape("".join(text)).split())
                text.clear()
                if block:
                    node = nodes[-1]
                    self.items.append((node, block))
                    self.chars[node] += len(block)
                    self.linked[node] += min(linked, len(block))
                    self.stops[node] += block.count(".") + block.count(",") + block.count("!") + block.count("?")
            linked = 0

        def innermost(some) -> int:
            """Place of the innermost open element of these names, 0 if none."""
            return max((open_at[n][-1] for n in some if open_at.get(n)), default=0)

        def close(place: int):
            nonlocal links
            flush()
            links = 0
            while len(names) > place:
                open_at[names.pop()].pop()
                nodes.pop()

        at = 0
        last = html.rfind(">") + 1  # beyond it no tag can end
        for m in _TOKEN.finditer(html, 0, last):
            if m.start() > at and not muted:
                piece = html[at : m.start()]
                text.append(piece)
                if links:
                    linked += len(piece)
            at = m.end()
            if m[3] is None:
                continue
            name = m[3].lower()
            if muted:
                if name == muted:
                    inner += -1 if m[2] else not m[4].endswith("/")
                if inner and not (name in _CLOSES_P and not m[2] and muted in _MUTE_TO_BLOCK):
                    continue
                ended, muted = inner == 0, ""
                if ended:
                    continue
            if name in _MUTE:
                if not m[2] and not m[4].endswith("/"):
                    muted, inner = name, 1
                    self.inputs[nodes[-1]] += name == "select"
                continue
            if name in _INLINE:
                if name == "a":
                    links = 0 if m[2] else 1
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in _VOID:
                if name == "hr":
                    flush()
                elif name == "input":
                    self.inputs[nodes[-1]] += 1
                continue
            if m[2]:
                if place := innermost((name,)):
                    close(place)
                elif name == "p":
                    flush()
                continue
            if name == "html":
                continue
            flush()
            links = 0
            if name == "body" and (place := innermost(("head",))):
                close(place)
            if name in _CLOSES_P and (place := innermost(("p",))):
                close(place)
            if name in _CLOSED_BY:
                ends, walls = _CLOSED_BY[name]
                if (place := innermost(ends)) > innermost(walls):
                    close(place)
            if name == "button":
                self.inputs[nodes[-1]] += 1
            if name[0] == "h" and name[1:].isdigit() and names[-1][0] == "h" and names[-1][1:].isdigit():
                close(len(names) - 1)
            nodes.append(self._node(nodes[-1], name, m[4], page))
            open_at.setdefault(name, []).append(len(names))
            names.append(name)
        if at < len(html) and not muted and not (at == last and at and html[at - 1] != ">"):
            text.append(html[at:])
        flush()


def _by_depth(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


class Columns:
    """Trees as arrays, with sums over subtrees and the features of all nodes."""

    def __init__(self, trees: Trees):
        n = len(trees.parent)
        self.n = n
        self.parent = np.array(trees.parent, np.int64)
        self.depth = np.array(trees.depth, np.int64)
        self.page = np.array(trees.page, np.int64)
        self.tag = np.array(trees.tag, np.int64)
        self.hidden = np.array(trees.hidden, bool)
        self.levels = _by_depth(self.depth)
        self.item_node = np.array([i for i, _ in trees.items], np.int64)
        self.groups = (np.array(trees.groups, np.int64)[:, None] >> np.arange(_N_GROUPS)) & 1
        self.own = np.stack([np.array(x, np.float64) for x in (trees.chars, trees.linked, trees.stops, trees.inputs)], axis=1) if n else np.zeros((0, 4))

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(np.float64, copy=True)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def down(self, flags: np.ndarray) -> np.ndarray:
        """Whether a proper ancestor has each flag."""
        out = np.zeros_like(flags)
        for level in self.levels[1:]:
            out[level] = out[self.parent[level]] | flags[self.parent[level]]
        return out

    def features(self) -> np.ndarray:
        n = self.n
        kinds = np.eye(len(_TAGS), dtype=np.int64)[self.tag]
        base = np.concatenate([self.own, np.ones((n, 1)), kinds[:, [_TAG_NUMBER["p"], _TAG_NUMBER["li"]]]], axis=1)
        sub = self.up(base)
        chars, linked, stops, inputs, nodes, paragraphs, entries = sub.T
        roots = np.flatnonzero(self.parent == np.arange(n))
        root = roots[np.searchsorted(roots, np.arange(n), side="right") - 1]
        whole = np.maximum(chars[root], 1)
        before = np.cumsum(self.own[:, 0]) - self.own[:, 0]
        before -= before[root]
        # Siblings, in order: nodes are stored in page order.
        order = np.lexsort((np.arange(n), self.parent))
        order = order[self.parent[order] != order]
        p = self.parent[order]
        new = np.ones(len(order), bool)
        new[1:] = p[1:] != p[:-1]
        group = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(order)))
        place, siblings, alike, left, right, share = (np.zeros(n) for _ in range(6))
        place[order] = np.arange(len(order)) - firsts[group] if len(order) else 0
        siblings[order] = sizes[group] if len(order) else 0
        same = p * len(_TAGS) + self.tag[order]
        _, inverse, counts = np.unique(same, return_inverse=True, return_counts=True)
        alike[order] = counts[inverse]
        lefts = np.where(new, -1, np.roll(order, 1)) if len(order) else order
        left[order] = np.where(lefts >= 0, chars[lefts], 0)
        rights = np.where(np.roll(new, -1), -1, np.roll(order, -1)) if len(order) else order
        right[order] = np.where(rights >= 0, chars[rights], 0)
        share[order] = chars[order] / np.maximum(chars[p], 1)
        above_groups, above_kinds = self.down(self.groups), self.down(kinds)
        lead = "article main nav header footer aside form list table quote".split()
        numbers = [
            np.log1p(chars),
            np.log1p(self.own[:, 0]),
            linked / np.maximum(chars, 1),
            stops / np.maximum(chars, 1),
            np.log1p(chars / nodes),
            np.log1p(nodes),
            np.log1p(paragraphs),
            entries / nodes,
            np.minimum(inputs, 5),
            chars / whole,
            before / whole,
            (before + chars) / whole,
            np.minimum(self.depth, 20),
            np.minimum(place, 30),
            np.minimum(siblings, 60),
            alike / np.maximum(siblings, 1),
            np.log1p(left),
            np.log1p(right),
            share,
            np.log1p(whole),
        ]
        return np.concatenate([np.stack(numbers, axis=1), self.groups, above_groups, kinds, above_kinds[:, [_TAG_NUMBER[t] for t in lead]]], axis=1).astype(np.float32)

    def decode(self, odds: np.ndarray, split: float = SPLIT) -> np.ndarray:
        """Which items are taken, given each node's log-odds of being in the article."""
        take, leave = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        all_in, all_out = self.up(take), self.up(leave)
        own = np.maximum(take, leave)
        best, divided = np.maximum(all_in, all_out), np.zeros(self.n, bool)
        parts = np.zeros(self.n)
        for level in self.levels[::-1]:
            apart = split + own[level] + parts[level]
            divided[level] = apart > best[level]
            best[level] = np.maximum(best[level], apart)
            inner = level[self.parent[level] != level]
            np.add.at(parts, self.parent[inner], best[inner])
        state = np.where(divided, 0, np.where(all_in > all_out, 1, -1))
        for level in self.levels[1:]:
            above = state[self.parent[level]]
            state[level] = np.where(above != 0, above, state[level])
        final = np.where(state == 0, np.where(odds > 0, 1, -1), state)
        return ((final > 0) & ~self.hidden)[self.item_node]


@dataclass
class Boosted:
    """Boosted oblivious trees on binned features, logistic loss."""

    edges: list[np.ndarray]
    trees: list[tuple[list[int], list[int], np.ndarray]]
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros(x.shape, np.uint8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        b = np.ascontiguousarray(self.bins(x).T)
        out = np.full(len(x), self.base)
        for columns, cuts, values in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for c, cut in zip(columns, cuts):
                leaf = leaf * 2 + (b[c] > cut)
            out += values[leaf]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 5, rate: float = 0.25, n_bins: int = 24, ridge: float = 5.0) -> Boosted:
        edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n_bins + 1)[1:-1])) for i in range(x.shape[1])]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        made = cls(edges, [], float(np.log(share / (1 - share))))
        b = np.ascontiguousarray(made.bins(x).T).astype(np.int64)
        score = np.full(len(x), made.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(len(x), np.int64)
            columns, cuts = [], []
            for level in range(depth):
                leaves = 1 << level
                top = (-1.0, 0, 0)
                for c in range(x.shape[1]):
                    size = len(edges[c]) + 1
                    if size < 2:
                        continue
                    key = leaf * size + b[c]
                    gs = np.bincount(key, g, leaves * size).reshape(leaves, size).cumsum(1)
                    hs = np.bincount(key, h, leaves * size).reshape(leaves, size).cumsum(1)
                    gain = (gs[:, :-1] ** 2 / (hs[:, :-1] + ridge) + (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + ridge)).sum(0)
                    k = int(gain.argmax())
                    if gain[k] > top[0]:
                        top = (float(gain[k]), c, k)
                columns.append(top[1])
                cuts.append(top[2])
                leaf = leaf * 2 + (b[top[1]] > top[2])
            values = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
            made.trees.append((columns, cuts, values))
            score += values[leaf]
        return made


@lru_cache(maxsize=4)
def trained(pages: int = 1400, seed: int = 3) -> Boosted:
    """Trees trained on ``pages`` generated pages."""
    from .pagegen import page

    random = np.random.default_rng(seed)
    trees, labels = Trees(), []
    for i in range(pages):
        html, blocks = page(random)
        seen = len(trees.items)
        trees.add(html, i)
        labels += [blocks.get(text, False) for _, text in trees.items[seen:]]
    c = Columns(trees)
    wanted = np.zeros(c.n)
    size = np.array([len(t) for _, t in trees.items], float)
    np.add.at(wanted, c.item_node, size * np.array(labels, float))
    chars = c.up(c.own[:, 0])
    inside = c.up(wanted)
    used = chars > 0
    return Boosted.fit(c.features()[used], (inside[used] > 0.5 * chars[used]).astype(float))


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page, empty if none."""
    trees = Trees()
    for i, html in enumerate(pages):
        if html:
            trees.add(html, i)
    if not trees.items:
        return [""] * len(pages)
    c = Columns(trees)
    taken = c.decode(model.odds(c.features()))
    out: list[list[str]] = [[] for _ in pages]
    for (node, text), yes in zip(trees.items, taken.tolist()):
        if yes:
            out[trees.page[node]].append(text)
    return ["\n".join(x) for x in out]


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    text holds the article's blocks, character references decoded, white space turned into one
    space and trimmed, in page order, joined by a newline. Null and empty html give an empty
    text. Whole pages are read, whatever their length and nesting, in time that follows it. Where
    taking a subtree and splitting it are as good, it is not split; where taking and leaving it
    are, it is left. Repeated rows are kept; extra columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = slim.drop("html").schema.add("text", "string").add("n_chars", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[str] = []
            some, chars = [], 0
            for h in b.column(2):
                some.append(h.as_py())
                chars += len(some[-1] or "")
                if chars > STEP_CHARS:
                    found += main_texts(some, shared.value)
                    some, chars = [], 0
            found += main_texts(some, shared.value) if some else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=names)

    return slim.mapInArrow(run, schema)
