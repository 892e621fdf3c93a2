"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text between block boundaries is a node with two states, content or not. A node's
own evidence is a logistic model over its features (tag, name words of class, id and role, length, link share,
punctuation). Potentials between parent and child say how a state carries over, for runs, for elements and for named
elements. The graph is a tree, so one pass of sum-product messages from the leaves upward and one from the root downward
give the exact marginal of every node. Runs whose marginal of content is at least one half are the text.

Trained on labelled pages: ``labelled_pages`` writes pages of many layouts with the label of every run and element, from
lists of usual names and a seed; their number is a parameter. No page of a query's table is learned from.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import random
import re

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import minimise
from .shared import shared_dir, table

# HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What they hold is no text of the page: scripts, styles, form controls, another document, names of drawings.
RAW = frozenset("script style template textarea title iframe select datalist desc metadata annotation annotation-xml".split())
BLOCK = frozenset(
    "html head body address article aside blockquote button center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"html", "head", "body", "button", "label", "legend", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An open element of the key ends where one of the values opens, unless one of SCOPE stands between.
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
}
SCOPE = frozenset("ul ol dl table select menu".split())

#: Open elements that an end tag doesn't reach across, and the ones whose end tags do.
CELLS = ("td", "th", "table")
ROWS = frozenset("tr table tbody thead tfoot body html".split())
CLOSES = {tag: [k for k, v in CLOSED_BY.items() if tag in v] for tag in set().union(*CLOSED_BY.values())}

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: One attribute, or what stands in the place of one: name, value with its quotes. A quote without an end is no value.
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?)?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"[\s\x00]+")


@lru_cache(maxsize=None)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE)


@dataclass
class Node:
    parent: int
    tag: str
    names: tuple[str, ...] = ()
    parts: list = field(default_factory=list)
    link_chars: int = 0
    is_text: bool = False
    text: str = ""


def tags(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str], bool]]:
    """(start, end, name, whether an end tag, attributes, whether closed by itself) of each tag; of comments and
    declarations name is empty. Each character is looked at a bounded number of times, however bad the markup.

    A quoted value ends at its own quote; where a quote has no end, the tag ends at the next ">". A "<" that no name
    follows, or no ">", is text. The caller may send a place to go on from, behind what a tag holds.
    """
    at, last = page.find("<"), page.rfind(">")
    while 0 <= at <= last:
        start = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            found = (start, end, "", False, {}, False)
        elif page.startswith(("<!", "<?", "</"), at) and not NAME.match(page, at):
            end = page.find(">", at) + 1
            if page.startswith("</", at) and not page.startswith("</>", at) and page[at + 2 : at + 3].isspace():
                at = page.find("<", at + 1)
                continue
            found = (start, end, "", False, {}, False)
        elif m := NAME.match(page, at):
            at, attributes, alone = m.end(), {}, False
            while at < len(page) and page[at] != ">":
                x = ATTRIBUTE.match(page, at)
                alone = page[x.end() - 1] == "/"
                at = x.end()
                if x[1] is not None:
                    attributes.setdefault(x[1].lower(), (x[2] or "").strip("\"'"))
                if page.startswith(("'", '"'), at):  # a quote without an end
                    break
            end = page.find(">", at) + 1
            if not end:  # the rest has no end of a tag
                return
            found = (start, end, m[2].lower(), bool(m[1]), attributes, alone)
        else:
            at = page.find("<", at + 1)
            continue
        sent = yield found
        at = page.find("<", found[1] if sent is None else sent)


def parse(page: str, scripting: bool = False) -> list[Node]:
    """Nodes in page order; the first is the root, a parent stands before its children. What an element with the attribute
    hidden, or with a style that hides it, holds is not on the page; nor, with scripting, as in a browser, what noscript
    holds. The work is linear in the page's length."""
    nodes = [Node(-1, "#root")]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, with the node that their text belongs under
    open_at: dict[str, list[int]] = {}  # for each tag the depths at which it is open
    blocks: list[int] = []  # the depths of open block elements
    run, unseen = None, 0  # unseen: the depth of the outermost hidden element

    def text(raw: str) -> None:
        nonlocal run
        if not raw or unseen:
            return
        if run is None:
            if not raw.strip():
                return
            run = Node(stack[-1][1], "#text", is_text=True)
            nodes.append(run)
        raw = html.unescape(raw)
        run.parts.append(raw)
        if open_at.get("a"):
            run.link_chars += len(raw)

    def push(tag: str, node: int) -> None:
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, node))

    def pop_to(depth: int) -> None:
        nonlocal run, unseen
        while len(stack) > depth:
            tag, _ = stack.pop()
            open_at[tag].pop()
            if tag in BLOCK:
                blocks.pop()
                run = None
        if unseen >= depth:
            unseen = 0

    def nearest(names) -> int:
        """The depth of the innermost open element of those names, 0 if there is none."""
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    found, done, go_on = tags(page), 0, None
    while True:
        try:
            start, end, tag, closing, attributes, alone = found.send(go_on)
        except StopIteration:
            text(page[done:])
            break
        text(page[done:start])
        done, go_on = end, None
        if not tag:
            continue
        if closing:
            depth = nearest((tag,))
            if tag == "br":
                text(" ")
            elif depth and (tag in ROWS or depth >= nearest(CELLS)):
                pop_to(depth)
            continue
        if tag in RAW or (scripting and tag == "noscript"):
            if not alone:
                close = raw_end(tag).search(page, end)
                done = go_on = (page.find(">", close.end()) + 1 if close else 0) or len(page)
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                run = None
            else:
                text(" ")
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            pop_to(blocks[-1])
        while tag in CLOSES:
            depth = nearest(CLOSES[tag])
            if depth <= nearest(SCOPE):
                break
            cell = stack[depth][0] in ("td", "th")
            pop_to(depth)
            if not cell:
                break
        if alone and tag in BLOCK:
            run = None
            continue
        if tag in BLOCK:
            run = None
            names = []
            for key in ("class", "id", "role"):
                names += WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes.get(key, "")).lower())
            if not unseen:
                nodes.append(Node(stack[-1][1], tag, tuple(dict.fromkeys(names))))
            push(tag, len(nodes) - 1)
        else:
            push(tag, stack[-1][1])
        if not unseen and ("hidden" in attributes or UNSEEN.search(attributes.get("style", ""))):
            unseen = len(stack) - 1
    for x in nodes:
        if x.is_text:
            x.text = SPACES.sub(" ", "".join(x.parts)).strip()
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """The features of each node, as names; lengths and shares come in steps. where: whether the page has an article (or
    else a main) element, and the node is in one."""
    chars, linked = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.is_text:
            chars[i], linked[i] = len(x.text), min(x.link_chars, len(x.text))
        if x.parent >= 0:
            chars[x.parent] += chars[i]
            linked[x.parent] += linked[i]
    mark = next((t for t in ("article", "main") if any(x.tag == t for x in nodes)), None)
    inside = [False] * len(nodes)
    out = []
    for i, x in enumerate(nodes):
        inside[i] = x.tag == mark or (x.parent >= 0 and inside[x.parent])
        where = "where=any" if mark is None else "where=inside" if inside[i] else "where=outside"
        size = min(9, chars[i].bit_length() - 2) if chars[i] > 3 else 0
        share = round(4 * linked[i] / chars[i]) if chars[i] else 0
        if x.is_text:
            up = nodes[x.parent]
            stops = sum(map(x.text.count, ".!?;:,…。，"))
            f = ["run", f"run {where}", f"in={up.tag}", f"run size={size}", f"run links={share}"]
            f.append(f"run stops={min(3, stops)}")
            f += [f"in name={w}" for w in up.names]
        else:
            f = ["element", where, f"tag={x.tag}", f"size={size}", f"links={share}"]
            f += [f"name={w}" for w in x.names] + [f"name^{w[:5]}" for w in x.names if len(w) > 5]
        out.append(f)
    return out


# Elements that hold text, and elements that are seldom part of one.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure figcaption".split())
ASIDE = frozenset("nav aside form footer header button fieldset label legend dialog menu option details".split())


N_KINDS = 5


def kind(x: Node) -> int:
    """The kind of edge above a node: to a run, a textual element, a plain or a named container, an element beside texts."""
    if x.is_text:
        return 0
    if x.tag in ASIDE:
        return 4
    if x.names:
        return 3
    return 1 if x.tag in TEXTUAL else 2


@dataclass(frozen=True)
class TreeModel:
    weights: dict[str, float]
    edges: tuple  # [kind][parent state][child state]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability that each node is content: sum-product, leaves to root and back."""
        n, w = len(nodes), self.weights
        own = []
        for f in features(nodes):
            z = max(-30.0, min(30.0, sum(w.get(x, 0.0) for x in f)))
            p = 1.0 / (1.0 + math.exp(-z))
            own.append((1.0 - p, p))
        below, up = list(own), [(1.0, 1.0)] * n  # below: own evidence and messages of the children
        for i in range(n - 1, 0, -1):
            b0, b1 = below[i]
            e = self.edges[kind(nodes[i])]
            m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
            s = m0 + m1
            up[i] = m0, m1 = m0 / s, m1 / s
            p0, p1 = below[nodes[i].parent]
            p0, p1 = p0 * m0, p1 * m1
            below[nodes[i].parent] = p0 / (p0 + p1), p1 / (p0 + p1)
        belief = list(below)
        for i in range(1, n):
            p0, p1 = belief[nodes[i].parent]
            p0, p1 = p0 / max(up[i][0], 1e-300), p1 / max(up[i][1], 1e-300)  # without this child's own message
            e = self.edges[kind(nodes[i])]
            d0, d1 = p0 * e[0][0] + p1 * e[1][0], p0 * e[0][1] + p1 * e[1][1]
            b0, b1 = below[i][0] * d0, below[i][1] * d1
            belief[i] = b0 / (b0 + b1), b1 / (b0 + b1)
        return [b for _, b in belief]


def extract(page: str | None, model: TreeModel) -> str:
    if not page:
        return ""
    nodes = parse(page, scripting=True)
    kept = (x.text for x, p in zip(nodes, model.marginals(nodes), strict=True) if x.is_text and p >= 0.5)
    return "\n".join(t for t in kept if t)


def either(logs: np.ndarray) -> np.ndarray:
    """Log of the sum over the last axis, of both states."""
    return np.logaddexp(logs[..., 0], logs[..., 1])


class Forest:
    """The trees of many pages as arrays; sum-product by depth, over all pages at once."""

    def __init__(self, parent: np.ndarray, kinds: np.ndarray):
        self.parent, self.kinds = parent, kinds
        depth = np.zeros(len(parent), int)
        for i in range(len(parent)):  # parents come first
            depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
        self.levels = [np.flatnonzero(depth == k) for k in range(depth.max(initial=0) + 1)]

    def infer(self, z: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log of the partition function, the marginals of content, and of (parent, child) states on the edge above."""
        below = np.stack([np.zeros_like(z), z], axis=1)
        up = np.zeros_like(below)
        for nodes in reversed(self.levels[1:]):
            up[nodes] = either(theta[self.kinds[nodes]] + below[nodes, None, :])
            np.add.at(below, self.parent[nodes], up[nodes])
        belief, pairs = below.copy(), np.zeros((len(z), 2, 2))
        roots = self.levels[0]
        total = either(below[roots]).sum()
        for nodes in self.levels[1:]:
            rest = belief[self.parent[nodes]] - up[nodes]
            joint = rest[:, :, None] + theta[self.kinds[nodes]] + below[nodes, None, :]
            belief[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
            pairs[nodes] = np.exp(joint - either(belief[nodes])[:, None, None])
        return total, 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs


def train(pages: list[tuple[str, list[bool]]], l2: float = 0.1, steps: int = 250) -> TreeModel:
    """pages: (html, whether each run is content, in page order). An element is content if most text inside it is.

    Evidence and edges are fitted together: the likelihood of all states of a page given its features, whose gradient
    is what sum-product expects less what is seen. Edges of a kind have a weight for each pair of states.
    """
    rows, states, parents, kinds = [], [], [], []
    for page, labels in pages:
        nodes = parse(page)
        runs = [i for i, x in enumerate(nodes) if x.is_text]
        if len(runs) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(runs)} runs")
        good, all_ = [0] * len(nodes), [0] * len(nodes)
        for i, y in zip(runs, labels, strict=True):
            good[i], all_[i] = y * len(nodes[i].text), len(nodes[i].text)
        for i in range(len(nodes) - 1, 0, -1):
            good[nodes[i].parent] += good[i]
            all_[nodes[i].parent] += all_[i]
        states += [int(2 * g > a) for g, a in zip(good, all_, strict=True)]
        parents += [len(rows) + x.parent if x.parent >= 0 else -1 for x in nodes]
        kinds += [kind(x) for x in nodes]
        rows += features(nodes)
    index = {f: k for k, f in enumerate(dict.fromkeys(f for r in rows for f in r))}
    i = np.array([n for n, r in enumerate(rows) for _ in r])
    j = np.array([index[f] for r in rows for f in r])
    y, parent, kinds_ = np.array(states), np.array(parents), np.array(kinds)
    forest, n = Forest(parent, kinds_), len(index)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (kinds_[child], y[parent[child]], y[child]), 1)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        theta = w[n:].reshape(N_KINDS, 2, 2)
        z = np.bincount(i, w[:n][j], minlength=len(y))
        total, marginal, pairs = forest.infer(z, theta)
        expected = np.zeros_like(seen)
        np.add.at(expected, kinds_[child], pairs[child])
        grad = np.concatenate([np.bincount(j, (marginal - y)[i], minlength=n), (expected - seen).ravel()])
        return total - (z * y).sum() - (seen * theta).sum() + l2 / 2 * w @ w, grad + l2 * w

    w = minimise(loss, np.zeros(n + 4 * N_KINDS), steps, 0.05)
    edges = np.exp(w[n:].reshape(N_KINDS, 2, 2))
    return TreeModel({f: float(w[k]) for f, k in index.items()}, tuple(tuple(map(tuple, e)) for e in edges.tolist()))


# Usual names of parts of pages.
PARTS = {
    "menu": "nav navigation menu navbar topnav breadcrumb breadcrumbs tabs pager pagination toc links",
    "header": "header masthead top banner branding logo topbar",
    "footer": "footer bottom colophon copyright legal credits imprint",
    "sidebar": "sidebar aside widget rail related recommended more popular trending teaser tags archive",
    "notice": "notice cookie consent gdpr alert message popup modal overlay disclaimer privacy warning",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp outbrain",
    "form": "form search login signup subscribe newsletter contact register",
    "comments": "comments comment replies reply discussion disqus respond commentlist reader",
    "share": "share social sharing follow like meta byline tools",
}
GOOD = "content article post entry story text body main page copy detail news blog single hentry prose".split()


def labelled_pages(n: int = 1500, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """n pages of random layouts and the labels of their runs in page order."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        return " ".join(words(1, 18).capitalize() + rng.choice(". . . ! ?".split()) for _ in range(rng.randint(a, b)))

    def odd() -> str:
        """Text as few people write it: no stop in a hundred words, one behind each, bars between words, a word repeated."""
        some = [word() for _ in range(rng.choice([2, 6, 15, 40, 120]))]
        some = rng.choice([some, [rng.choice(some)] * len(some), [x.upper() + rng.choice(["!!", ".", ","]) for x in some], [x for y in some for x in (y, "|")]])
        return " ".join(some)

    def names(part: str, p: float = 0.85) -> str:
        chosen = rng.choice(PARTS[part].split())
        if rng.random() > p:
            return ""
        style = rng.choice(["{}", "{}", "{}-{}", "{}_{}", "site-{}", "{} {}", "{}-{}", "{1}-{0}"])
        beside = rng.choice(GOOD) if rng.random() < 0.4 else word()  # main-menu, page-footer: the part is what counts
        return f' {rng.choice(["class", "class", "id"])}="{style.format(chosen, beside)}"'

    def good(p: float = 0.7) -> str:
        return f' {rng.choice(["class", "id"])}="{rng.choice(GOOD)}"' if rng.random() < p else ""

    pages = []
    for _ in range(n):
        out: list[str] = []
        labels: list[bool] = []

        def run(text: str, label: bool) -> None:
            out.append(text)  # noqa: B023
            labels.append(label)  # noqa: B023

        def block(tag: str, attrs: str, text: str, label: bool) -> None:
            out.append(f"<{tag}{attrs}>")  # noqa: B023
            run(text, label)
            out.append(f"</{tag}>")  # noqa: B023

        def link_list(attrs: str, k: int) -> None:
            out.append(f"<ul{attrs}>")  # noqa: B023
            for _ in range(k):
                block("li", "", f'<a href="/{word()}">{words(1, 4)}</a>', False)
            out.append("</ul>")  # noqa: B023

        def reading_list() -> None:
            """Links that belong to the article: a plain list in it, under a heading or not."""
            if rng.random() < 0.5:
                block(rng.choice(["h2", "h3", "p"]), "", words(1, 3).capitalize(), True)
            list_tag = rng.choice(["ul", "ul", "ol"])
            out.append(f"<{list_tag}>")  # noqa: B023
            for _ in range(rng.randint(1, 5)):
                link = f'<a href="/{word()}">{words(1, 6)}</a>'
                block("li", "", link if rng.random() < 0.8 else f"{link}, {words(1, 5)}", True)
            out.append(f"</{list_tag}>")  # noqa: B023

        def boilerplate(part: str) -> None:
            tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(part, "div")
            if rng.random() < 0.3:
                tag = rng.choice(["div", "section", "ol", "ul"] if part == "comments" else ["div", "section"])
            named = names(part, 0.5 if tag not in ("div", "section") else 1.0)
            out.append(f"<{tag}{named}>")  # noqa: B023
            for _ in range(rng.randint(1, 4) if part in ("comments", "sidebar") else 1):
                r = rng.random()
                if part == "sidebar" and rng.random() < 0.3:
                    block(rng.choice(["h3", "h4", "div"]), "", words(1, 3).capitalize(), False)
                if part in ("menu", "share") or (part in ("sidebar", "footer") and r < 0.5):
                    link_list("" if r < 0.7 else names(part), rng.randint(2, 8))
                elif part == "comments":
                    inner = names("comments", 0.6)
                    if r < 0.3:
                        block(rng.choice(["h2", "h3", "h4"]), "", words(1, 3).capitalize() + rng.choice(["", " (3)"]), False)
                    if tag in ("ol", "ul"):
                        block("li", inner if r < 0.3 else "", prose(1, 6), False)
                    elif r < 0.6:
                        block("div", inner, words(1, 3), False)
                        block("p", "", prose(1, 6), False)
                    else:
                        block(rng.choice(["p", "div"]), inner, prose(1, 6), False)
                elif part == "form":
                    block(rng.choice(["label", "p", "div"]), "", words(1, 8), False)
                    out.append('<input name="q">')  # noqa: B023
                    block("button", "", words(1, 2), False)
                elif part == "header" and r < 0.4:
                    block(rng.choice(["h1", "h2", "div"]), "", words(1, 4).capitalize(), False)
                    if r < 0.2:
                        block("p", "", words(2, 9).capitalize() + rng.choice(["", "."]), False)
                elif part == "header":
                    block(rng.choice(["a", "div", "p"]), "", words(1, 5), False) if r < 0.5 else block("p", names(part), words(1, 6), False)
                elif r < 0.5:
                    block("p", "", prose(1, 4) if r < 0.3 else words(2, 14), False)
                else:
                    run(prose(1, 5) if r < 0.75 else "&copy; " + words(2, 12) + ".", False)
                    out.append("<hr>")  # noqa: B023
            out.append(f"</{tag}>")  # noqa: B023

        before = rng.sample(["menu", "header", "notice", "advert", "form", "menu", "advert"], rng.randint(1, 5))
        after = rng.sample(["sidebar", "footer", "comments", "share", "form", "advert", "notice", "footer"], rng.randint(1, 6))
        out.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        wrapped = rng.random() < 0.3
        if wrapped:
            out.append(f'<div{rng.choice(["", " class=wrapper", " id=container", " class=page"])}>')
        for part in before:
            boilerplate(part)
        outer = rng.choice(["", "", "main", "div", "section"])  # one element around the article and what stands beside it
        beside = rng.sample(["comments", "share", "sidebar", "advert", "form", "notice"], rng.randint(1, 3)) if outer else []
        if outer:
            out.append(f"<{outer}{good()}>")
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        out.append(f"<{tag}{good(1.0 if tag in ('div', 'section') else 0.4)}>")
        if rng.random() < 0.7:
            headed = rng.random() < 0.2
            out.append("<header>" * headed)
            block(rng.choice(["h1", "h1", "h2"]), "", odd() if rng.random() < 0.2 else words(1, 12).capitalize() + rng.choice(["", "", "."]), True)
            if headed and rng.random() < 0.7:
                block(rng.choice(["p", "div"]), names("share"), words(2, 5).capitalize(), False)
            out.append("</header>" * headed)
        inside = [rng.choice(list(PARTS)) for _ in range(rng.choice([0, 0, 1, 2, 3, 4]))]
        k = rng.choice([1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 11, 14])
        spots = {rng.randint(0, k): part for part in inside}
        plain = rng.random() < 0.1
        for i in range(k):
            if i in spots:
                boilerplate(spots[i])
            r = rng.random()
            if k == 1 and r < 0.3:
                block("p", "", words(1, 3).capitalize() + ".", True)
            elif plain and i == 0:
                run(prose(1, 8), True)
                out.append("<hr>")
            elif r < 0.8:
                text = prose(1, rng.choice([1, 2, 3, 5, 8])) if rng.random() < 0.8 else words(1, 10).capitalize() + "."
                if rng.random() < 0.25:
                    text = f'{words(2, 9)} <a href="{word()}">{words(1, 3)}</a> {text}'
                block("p", "", odd() if rng.random() < 0.08 else text, True)
            elif r < 0.85:
                block(rng.choice(["h2", "h3"]), "", words(1, 8).capitalize(), True)
            elif r < 0.91:
                list_tag = rng.choice(["ul", "ul", "ol"])
                out.append(f"<{list_tag}>")
                longest = rng.choice([4, 14])
                for _ in range(rng.randint(2, 7)):
                    block("li", "", words(1, longest) + rng.choice(["", "."]), True)
                out.append(f"</{list_tag}>")
            elif r < 0.94:
                reading_list()
            elif r < 0.95:
                out.append("<details>")
                block("summary", "", words(1, 9).capitalize(), True)
                block("p", "", prose(1, 3), True)
                out.append("</details>")
            elif r < 0.97:
                block("blockquote", "", prose(1, 3), True)
            elif r < 0.98:
                out.append("<figure><img src=a>")
                block("figcaption", "", words(2, 12), True)
                out.append("</figure>")
            else:
                block("pre", "", words(3, 20), True)
        if rng.random() < 0.15:
            reading_list()
        if k in spots:
            boilerplate(spots[k])
        out.append(f"</{tag}>")
        for part in beside:
            boilerplate(part)
        if outer:
            out.append(f"</{outer}>")
        for part in after:
            boilerplate(part)
        out.append("</div>" * wrapped + "</body></html>")
        pages.append(("".join(out), labels))
    return pages


@lru_cache(maxsize=4)
def default_model(n_pages: int = 1500, seed: int = 7) -> TreeModel:
    return train(labelled_pages(n_pages, seed))


def stored_model(spark: SparkSession, n_pages: int = 1500, seed: int = 7) -> TreeModel:
    """default_model, fitted once for a shared folder: kept there as one line of JSON, under a digest of this module and of
    the parameters, so that another generator or other features get another model."""
    with open(__file__, "rb") as f:
        digest = hashlib.sha256(f.read() + f"{n_pages} {seed}".encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/html-model-{digest}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        weights, edges = json.loads(spark.read.text(path).first()["value"])
        return TreeModel(weights, tuple(tuple(map(tuple, e)) for e in edges))
    model = default_model(n_pages, seed)
    line = json.dumps([model.weights, model.edges])
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return model


def extract_pages(pages: DataFrame, model: TreeModel, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without html_col, and two more columns: the text and n_chars, its code points.

    A null or empty page has an empty text, and so has one without content. White space inside a block is one space,
    blocks are joined by one line feed. The other columns stay; ones named like the two new ones are replaced.
    """
    own = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    rest = pages.select(*own, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [extract(x, model) for x in part.column("__html").to_pylist()]
                columns = [part.column(c) for c in own] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*own, out_col, "n_chars"])

    schema = pages.select(*own).schema.add(out_col, "string").add("n_chars", "long")
    return rest.mapInArrow(run, schema)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), stored_model(spark))


QUERIES = {"op2_html_extract": op2_html_extract}
ORACLES: dict[str, str] = {}
