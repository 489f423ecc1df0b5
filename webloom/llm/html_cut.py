"""Main-text extraction by minimum cut.

A page is split into text blocks. A linear classifier over a block's text (length, link density, element, end mark) and
its ancestors gives a log-odds for content; its two sides become the capacities to the source (content) and the sink
(boilerplate). Smoothness edges tie blocks that follow one another on the page, and blocks under one parent that are
parted by others; their weight falls with the DOM distance. The minimum cut is the labelling of least cost: the text's
evidence, the markup's evidence and the neighbours' decide together, so that a short paragraph among long ones stays and
a long notice among menu items goes. Blocks whose own cost outweighs all their edges can be fixed beforehand without
losing the optimum (persistency); max-flow (Dinic) separates the rest.

Weights are fitted on a bounded sample of the pages (``sample_pages``, ``PAGE_BLOCKS``: documented parameters). Blocks
that lie in an article, or in a menu, footer, sidebar or form, label themselves; from these a logistic regression learns
the weights of the text, and the shares of neighbours with unlike labels give the edges' weights. Both are drawn towards
built-in values, which hold where the sample shows too little.

Inside an article or ``main``, comments, asides, forms, adverts, menus, notices and footers are boilerplate whatever
their text; outside, they are held for it less firmly. Names of classes are judged as whole names, never against the article or ``main`` that bears them, and the
vaguer ones (popular, widget, legal) can be outweighed by text. The larger the part of a page's likely text that lies in an article, the more speaks against what lies
outside, such as a notice without any telling name.

Edge cases: a null or empty page gives an empty text; truncated pages and unclosed tags are read as far as they go; very
long pages are read whole, one at a time; ties of the cut go to boilerplate; repeated rows are extracted row by row; an
empty table gives an empty result; extra columns are ignored. Nothing of a page is capped.
"""

from __future__ import annotations

import re
from collections import deque
from math import log, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.tokens import CLOSE, OPEN, TEXT, VOID, attributes, tokens
from webloom.llm.common import arrow_map, core

#: Elements that break a line of text into blocks.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text never shows or is no prose.
HIDDEN = frozenset("head script style noscript template svg math iframe object embed applet canvas audio video select option button textarea title datalist map".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
_SAME = {"li": "li", "dt": "dd dt", "dd": "dd dt", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}
_SAME_SETS = {k: frozenset(v.split()) for k, v in _SAME.items()}
_SCOPES = frozenset("ul ol dl table select body html article section div".split())

#: Class and id names of boilerplate. A name counts if it is one of these, or a compound that ends in one (site-footer), or one that begins with
#: one and ends in a word for a container (ad-box). Compounds that only say something about a page (has-sidebar, tag-news, comments-open) don't.
HARD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promos promotion promotions banner nav navbar navigation menu sidebar footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sign-up share sharing social related recommend recommended recommendation recommendations breadcrumb breadcrumbs login search copyright pagination pager skip-link outbrain taboola".split()
)
REPLY_NAMES = frozenset("comment comments disqus respond reply replies".split())
SOFT_NAMES = frozenset("side rail foot masthead topbar tag tags widget widgets toolbar legal trending popular author-box more-stories read-more".split())
CONTAINERS = frozenset("area bar block blocks box buttons card container content form inner item items links list panel posts row section slot text unit wrap wrapper zone".split())
#: First words of names that state a property of the page or its subject.
STATES = frozenset("has is no not with without hide show tag category cat topic type format status lang".split())
_HEAD_NAMES = frozenset(("header", "site-header", "page-header"))
_GOOD_WORD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body|text|article-body|post-content|entry-content)(?:$|[\s_-])", re.I)
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar alertdialog form".split())
_BAD_TAGS = frozenset("nav footer aside form menu dialog search".split())
_SPACE = re.compile(r"\s+")
#: How firmly the markup says boilerplate.
NO, SOFT, MAYBE, SURE = 0, 1, 2, 3


def names_one(name: str, known: frozenset[str]) -> bool:
    """Whether a class or id, taken whole, is one of the known names or a compound of it."""
    if name in known:
        return True
    words = name.split("-")
    if len(words) < 2 or words[0] in STATES:
        return False
    return words[-1] in known or "-".join(words[-2:]) in known or words[0] in known and words[-1] in CONTAINERS


class _Open:
    __slots__ = ("bad", "good", "hidden", "number", "tag")

    def __init__(self, tag: str, attrs: str, parent: _Open | None, number: int):
        self.tag, self.number = tag, number
        self.hidden = (parent.hidden if parent else False) or tag in HIDDEN
        self.bad = parent.bad if parent else NO
        self.good = parent.good if parent else 0
        inside = self.good == 2  # of an article or main
        bad, good = NO, 0
        if tag in ("article", "main"):
            good = 2
        elif tag in _BAD_TAGS or tag == "header" and not inside:
            bad = SURE
        if attrs and not attrs.isspace():
            a = attributes(attrs)
            names = f"{a.get('class', '')} {a.get('id', '')}"
            role = a.get("role", "").lower()
            if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
                self.hidden = True
            # What an article is called, or a page as a whole, says nothing against it.
            own = [] if tag in ("html", "body", "article", "main") else names.lower().replace("_", "-").split()
            if role in _BAD_ROLES or any(names_one(n, REPLY_NAMES) for n in own):
                bad = SURE
            elif any(names_one(n, HARD_NAMES) or not inside and n in _HEAD_NAMES for n in own):
                bad = max(bad, SURE if inside else MAYBE)
            elif any(names_one(n, SOFT_NAMES) for n in own):
                bad = max(bad, SOFT)
            elif role in ("main", "article"):
                good = 2
            elif names != " " and _GOOD_WORD.search(names):
                good = max(good, 1)
        if good == 2 and tag == "main" and self.bad in (SOFT, MAYBE):
            self.bad = NO  # a wrapper named after its sidebar
        self.bad = max(self.bad, bad)
        self.good = 0 if self.bad == SURE else max(self.good, good)


class Block:
    __slots__ = ("bad", "good", "linked", "path", "tag", "text")

    def __init__(self, text: str, linked: int, stack: list[_Open]):
        self.text, self.linked = text, linked
        top = stack[-1] if stack else None
        self.bad, self.good = (top.bad, top.good) if top else (NO, 0)
        self.path = tuple(x.number for x in stack if x.tag in BLOCKS)
        self.tag = next((x.tag for x in reversed(stack) if x.tag in BLOCKS), "")


def blocks(html: str) -> list[Block]:
    """Text blocks in page order, white space inside collapsed."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = links = number = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked, stack))
            parts.clear()
            linked = 0

    def pop(tags: frozenset[str] | set[str], scope: frozenset[str]) -> None:
        nonlocal links
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                flush()
                links -= sum(x.tag == "a" for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    for kind, value, attrs in tokens(html):
        if kind == TEXT:
            if not (stack and stack[-1].hidden):
                parts.append(value)
                if links:
                    linked += len(value.strip())
        elif kind == OPEN:
            if value in VOID:
                if value in ("br", "hr", "img"):
                    parts.append(" ")
                if value == "hr":
                    flush()
                continue
            if value in CLOSES_P:
                pop({"p"}, frozenset({"table", "td", "th", "button", "object"}))
            if value in _SAME_SETS:
                pop(_SAME_SETS[value], _SCOPES - _SAME_SETS[value])
            if value in BLOCKS:
                flush()
            number += 1
            stack.append(_Open(value, attrs, stack[-1] if stack else None, number))
            links += value == "a"
        elif kind == CLOSE and value not in VOID:
            if value in BLOCKS:
                pop({value}, frozenset())
            else:
                pop_inline(stack, value)
                links = sum(x.tag == "a" for x in stack) if value == "a" else links
    flush()
    return out


def pop_inline(stack: list[_Open], tag: str) -> None:
    """Close an inline element inside the current block."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag == tag:
            del stack[i]
            return
        if stack[i].tag in BLOCKS:
            return


class Costs(NamedTuple):
    """Weights of the text's features, and of edges by DOM distance: 0, 1, 2, 3 and more."""

    text: tuple[float, ...] = (-1.2, 0.9, -3.0, 0.5)
    edges: tuple[float, ...] = (1.25, 1.25, 0.75, 0.5)


#: Log-odds that the block's element gives: fixed, as sites agree on far fewer elements than articles differ in length.
ELEMENT_ODDS = dict.fromkeys(("p", "blockquote", "pre"), 0.8) | dict.fromkeys(("h1", "h2", "h3"), 1.0) | dict.fromkeys(("li", "td", "th", "dd"), -0.4)
#: Log-odds that the markup gives: by how firmly it says boilerplate, and by kind of content ancestor.
BAD_ODDS, GOOD_ODDS = (0.0, -3.0, -6.0, -9.0), (0.0, 1.8, 3.0)
#: Log-odds of a block outside every article and main where these hold all of the page's likely text; in proportion where they hold a part.
OUTSIDE_ODDS = -5.0
#: Most that an edge may weigh: two of them can't outweigh what the markup says for sure.
MOST_EDGE = 2.0
#: Bounds of the text's log-odds: no text outweighs what the markup says for sure.
MOST_TEXT = 4.0
#: Blocks of a page that the costs are fitted on: the first ones.
PAGE_BLOCKS = 400


def features(b: Block) -> tuple[float, ...]:
    """Of the text: constant, length, link density, end mark."""
    n = len(b.text)
    return (
        1.0,
        max(-1.5, min(3.0, log2(n / 40))),
        min(1.0, b.linked / n),
        float(b.text[-1] in ".!?…\"'”»:;"),
    )


def log_odds(b: Block, costs: Costs = Costs()) -> float:  # noqa: B008  a constant
    """The classifier: positive for content."""
    text = sum(w * x for w, x in zip(costs.text, features(b), strict=True))
    return max(-MOST_TEXT, min(MOST_TEXT, text + ELEMENT_ODDS.get(b.tag, 0.0))) + BAD_ODDS[b.bad] + GOOD_ODDS[b.good]


def article_share(found: list[Block]) -> float:
    """The share of a page's likely text, by code points, that lies in an article or main."""
    inside = sum(len(b.text) for b in found if told(b) == 1)
    likely = sum(len(b.text) for b in found if told(b) != 0)
    return inside / likely if likely else 0.0


def page_odds(found: list[Block], costs: Costs = Costs()) -> list[float]:  # noqa: B008  a constant
    """The classifier for the blocks of a page: an article elsewhere on the page speaks against what lies outside."""
    outside = OUTSIDE_ODDS * article_share(found)
    return [log_odds(b, costs) + (outside if b.good < 2 else 0.0) for b in found]


def distance(a: Block, b: Block) -> int:
    """DOM steps between the two blocks' elements beyond the one that parts siblings; 3 for more."""
    same = 0
    for x, y in zip(a.path, b.path, strict=False):
        if x != y:
            break
        same += 1
    return min(3, max(0, len(a.path) + len(b.path) - 2 * same - 1))


def neighbours(found: list[Block]) -> list[tuple[int, int]]:
    """Pairs of blocks that follow one another on the page, or, parted by others, under one parent: at most two a block."""
    pairs, last = [], {}
    for i, b in enumerate(found):
        if i:
            pairs.append((i - 1, i))
        parent = b.path[-2] if len(b.path) > 1 else 0
        if (j := last.get(parent)) is not None and j < i - 1:
            pairs.append((j, i))
        last[parent] = i
    return pairs


def told(b: Block) -> int | None:
    """What the markup says for sure: 1 content, 0 boilerplate, None nothing."""
    return 0 if b.bad == SURE else 1 if b.good == 2 and b.bad == NO else None


def fit_costs(pages: DataFrame, sample_pages: int = 1500, prior: float = 20.0) -> Costs:
    """Costs from at most ``sample_pages`` pages (the smallest hashes); ``prior``: how many blocks the built-in weights count for."""
    chosen = core(pages, "page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    sample = core(pages, "page_id", "html").join(F.broadcast(chosen), "page_id").dropDuplicates(["page_id"])

    def run(batch: pa.RecordBatch) -> dict:
        rows, near = [], []
        for html in batch.column("html").to_pylist():
            found = blocks(html or "")[:PAGE_BLOCKS]
            sides = [told(b) for b in found]
            rows += [list(features(b)) + [float(y)] for b, y in zip(found, sides, strict=True) if y is not None]
            for i, j in neighbours(found):
                if sides[i] is not None and sides[j] is not None:
                    near.append([float(distance(found[i], found[j])), float(sides[i] != sides[j])])
        kinds = [0] * len(rows) + [1] * len(near)
        return {"kind": kinds, "x": rows + near}

    found = arrow_map(sample, run, "kind int, x array<double>").groupBy("kind", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["kind"], r["x"]))
    blocks_, n_blocks = ([r["x"] for r in found if r["kind"] == 0], [r["n"] for r in found if r["kind"] == 0])
    unlike, total = [0.0] * 4, [0.0] * 4
    for r in found:
        if r["kind"] == 1:
            total[int(r["x"][0])] += r["n"]
            unlike[int(r["x"][0])] += r["n"] * r["x"][1]
    start = Costs()
    shares = [((unlike[d] + prior / (1 + np.exp(w))), total[d] + prior) for d, w in enumerate(start.edges)]
    edges = [float(min(MOST_EDGE, max(0.1, log((n - u) / u)))) for u, n in _rising(shares)]
    return Costs(_logistic(np.array(blocks_), np.array(n_blocks, float), np.array(start.text), prior), tuple(edges))


def _rising(shares: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """(part, whole) by distance, neighbours pooled until the shares rise: farther blocks are never tied closer."""
    pools: list[list] = []
    for part, whole in shares:
        pools.append([part, whole, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            p, w, n = pools.pop()
            pools[-1] = [pools[-1][0] + p, pools[-1][1] + w, pools[-1][2] + n]
    return [(p, w) for p, w, n in pools for _ in range(n)]


def _logistic(rows: np.ndarray, n: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25) -> tuple[float, ...]:
    """Weights of most likelihood (Newton's method) under a normal prior around ``start``; both classes weigh the same."""
    if not len(rows) or rows[:, -1].min() == rows[:, -1].max():
        return tuple(map(float, start))
    x, y = rows[:, :-1], rows[:, -1]
    given, x, start = x[:, 0] * start[0], x[:, 1:], start[1:]  # the constant stays: pages' menus say nothing about linkless short texts
    n = n * np.where(y > 0, 0.5 / (n * y).sum(), 0.5 / (n * (1 - y)).sum()) * n.sum()
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(given + x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w)), x.T @ (n * (y - p)) - prior * (w - start))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (Costs().text[0], *(round(float(v), 6) for v in w))


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: a wrong side costs \\|score\\|, a cut edge its weight."""
    n = len(scores)
    unary = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # persistency: a score that outweighs all edges decides, and pulls its neighbours
        v = queue.popleft()
        if label[v] is None and abs(unary[v]) >= sum(near[v].values()):
            label[v] = unary[v] > 0
            for u, w in near[v].items():
                unary[u] += w if label[v] else -w
                del near[u][v]
                queue.append(u)
            near[v] = {}
    core_nodes = [v for v in range(n) if label[v] is None]
    if core_nodes:
        for v, side in zip(core_nodes, _max_flow(core_nodes, unary, near), strict=True):
            label[v] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], unary: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm: blocking flows over the levels of shortest paths. True for nodes on the source side of the cut."""
    supply = {v: max(0.0, unary[v]) for v in nodes}
    demand = {v: max(0.0, -unary[v]) for v in nodes}
    left = {v: dict(near[v]) for v in nodes}
    tiny = 1e-9
    while True:
        level = {v: 0 for v in nodes if supply[v] > tiny}
        queue, reached = deque(level), False
        while queue:
            v = queue.popleft()
            reached = reached or demand[v] > tiny
            for u, c in left[v].items():
                if c > tiny and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if not reached:
            return [v in level for v in nodes]
        ways = {v: [u for u in left[v] if level.get(u) == level[v] + 1] for v in level}
        for source in [v for v in level if not level[v]]:
            path = [source]
            while path and supply[source] > tiny:
                v = path[-1]
                if demand[v] > tiny:
                    push = min([supply[source], demand[v], *(left[a][b] for a, b in zip(path, path[1:], strict=False))])
                    supply[source] -= push
                    demand[v] -= push
                    cut = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                        left[a][b] -= push
                        left[b][a] += push
                        if left[a][b] <= tiny:
                            cut = min(cut, k + 1)
                    del path[cut:]
                    continue
                while ways[v] and left[v][ways[v][-1]] <= tiny:
                    ways[v].pop()
                if ways[v]:
                    path.append(ways[v][-1])
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def label_blocks(html: str, costs: Costs = Costs(), smooth: bool = True) -> list[tuple[Block, bool]]:  # noqa: B008
    """Blocks and labels (True: content); without ``smooth`` by the classifier alone."""
    found = blocks(html)
    edges = [(i, j, costs.edges[distance(found[i], found[j])]) for i, j in neighbours(found)] if smooth else []
    return list(zip(found, min_cut(page_odds(found, costs), edges), strict=True))


def main_text(html: str | None, costs: Costs = Costs()) -> str:  # noqa: B008
    """Content blocks in page order, joined by one space."""
    return " ".join(b.text for b, content in label_blocks(html or "", costs) if content)


def extract_main_text(pages: DataFrame, costs: Costs | None = None) -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    costs = costs or fit_costs(pages)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h, costs) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

    return arrow_map(core(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


__all__ = ["Costs", "blocks", "extract_main_text", "fit_costs", "label_blocks", "main_text", "min_cut"]
