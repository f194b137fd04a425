"""Main-text extraction from HTML by minimum-cut labelling.

A page is cut into text blocks in page order. What a block costs if called content or boilerplate is the log-odds of a
linear classifier, all of them finite: the weights of its text (length, stops, link density, tag, place) are fitted on a
bounded sample of pages, where landmarks such as article and nav serve as weak labels, and marks on its elements (landmarks,
words in class and id) add log-odds of their own. These costs become capacities to the two terminals; neighbouring blocks,
and blocks under one parent, are tied by smoothness edges unless a mark stands between them. The minimum cut (by maximum
flow) is the labelling of least total cost, so a doubtful block follows its surroundings.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thinned

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*.?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")

# HTML element classes.
RAW = "script style noscript template textarea title iframe object svg math canvas audio video select".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
CHROME = "nav aside footer form menu dialog button fieldset search head".split()
#: Words in class, id or role that mark boilerplate and content.
CHROME_WORDS = """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu sidebar side
footer header masthead topbar toolbar cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login register share sharing social
related recommended recommendation recommendations more trending popular comment comments commentlist disqus reply replies respond discussion breadcrumb breadcrumbs
pagination pager widget popup modal overlay search form tags tagcloud copyright skip complementary contentinfo advertisment outbrain taboola""".split()
CONTENT_WORDS = "article articlebody content body main post entry story text prose".split()

_RAW, _VOID, _BLOCKS, _CHROME = set(RAW), set(VOID), set(BLOCKS), set(CHROME)
_CHROME_WORDS, _CONTENT_WORDS = set(CHROME_WORDS), set(CONTENT_WORDS)
_CLOSES_P = _BLOCKS - {"body", "html", "head"}
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: First words of class names that tell of a page's layout ("has-sidebar"), not of the element.
_LAYOUT = {"has", "with", "no", "without"}

#: Smoothness: between neighbours, more under one parent, next to nothing across marks.
NEIGHBOUR, SIBLING, ACROSS = 0.15, 1.4, 0.02
#: Log-odds of marks: landmark of boilerplate, word of boilerplate, such a word beside others, article or main, word of content.
LANDMARK, WORD, LAYOUT, ARTICLE, CONTENT = -5.0, -4.5, -1.0, 3.0, 1.5
#: The text's own log-odds lie within these bounds.
TEXT_LEAST, TEXT_MOST = -4.0, 3.0
#: Weights of the text before fitting: bias, length, stops, link density, paragraph, heading, list or table cell, short without a stop, edge of the page, copyright line.
PRIOR = np.array([-1.0, 2.5, 2.0, -3.5, 1.0, 0.8, -0.5, -0.7, -0.3, -3.0])
#: Most pages that fitting reads, blocks it takes of each, and how hard weights are held to PRIOR.
FIT_PAGES, FIT_BLOCKS, HOLD = 400, 100, 0.05


@dataclass
class Element:
    tag: str
    holder: int  # nearest block element, itself included
    parent: int  # the block element around that one
    holder_tag: str
    group: int  # nearest element with a mark
    mark: float  # log-odds of all marks
    chrome: bool
    article: bool


@dataclass
class Block:
    text: str
    parent: int
    group: int
    tag: str
    mark: float
    chrome: bool
    article: bool
    linked: int


def _mark_of(tag: str, attributes: str, article: bool) -> float:
    """Log-odds of an element's own tag and names; negative for boilerplate."""
    mark = 0.0
    if tag in _CHROME or (tag == "header" and not article):
        mark = LANDMARK
    elif tag in ("article", "main"):
        mark = ARTICLE
    if not attributes:
        return mark
    if _HIDDEN.search(attributes):
        return LANDMARK
    named, content, layout = False, False, False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if not _CHROME_WORDS.isdisjoint(words):
                if words[0] in _LAYOUT or (words[0] in _CONTENT_WORDS and words[-1] in _WRAPS):
                    layout = True
                else:
                    named = True
            elif not _CONTENT_WORDS.isdisjoint(words):
                content = True
    if tag in ("body", "html", "main") or (tag == "article" and content):
        return mark
    if named:
        return min(mark, WORD)
    if content and mark >= 0:
        mark = max(mark, CONTENT)
    return mark + LAYOUT if layout else mark


_WRAPS = {"wrap", "wrapper", "container", "layout", "area"}


def _element(tag: str, attributes: str, key: int, parent: Element) -> Element:
    own = _mark_of(tag, attributes, parent.article)
    article = parent.article or tag in ("article", "main")
    chrome = parent.chrome or own <= WORD
    if own <= WORD:  # boilerplate inside an article does not profit from it
        mark = min(parent.mark, 0.0) + own if parent.mark > own else parent.mark
    elif parent.chrome:  # nor does content inside boilerplate redeem it
        mark = parent.mark
    elif own > 0:
        mark = max(parent.mark, min(parent.mark, 0.0) + own)
    else:
        mark = parent.mark + own
    group = key if own <= WORD or tag in ("article", "main") else parent.group
    if tag in _BLOCKS:
        return Element(tag, key, parent.holder, tag, group, mark, chrome, article)
    return Element(tag, parent.holder, parent.parent, parent.holder_tag, group, mark, chrome, article)


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order; scripts, styles and other raw elements are left out."""
    out: list[Block] = []
    stack = [Element("html", 0, 0, "html", 0, 0.0, False, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, key, links = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            top = stack[-1]
            out.append(Block(text, top.parent, top.group, top.holder_tag, top.mark, top.chrome, top.article, min(linked, len(text))))
        linked = 0

    def close(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def say(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    at = 0
    while True:
        m = _MARKUP.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCKS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in _BLOCKS and stack[i].tag in _BLOCKS:
                    break  # a stray end tag of an inline element does not close a block
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}\\s*[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            parts.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            parts.append(" ")
            continue
        if tag in _BLOCKS:
            flush()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in _BLOCKS:
                        break
            if tag in _IMPLIED:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in _IMPLIED[tag]:
                        close(i)
                        break
                    if stack[i].tag in _STOPS[tag]:
                        break
        if tag == "a":
            links = 1
        if tag == "body":
            close(1)
        key += 1
        stack.append(_element(tag, m[3], key, stack[-1]))
        opened[tag] += 1
    flush()
    return out


_HEADINGS, _CELLS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "td", "th", "dt", "dd", "legend", "caption"}


def text_features(b: Block, place: float) -> list[float]:
    """What PRIOR weighs; place is where the block stands in its page, from 0 to 1."""
    stops = sum(b.text.count(c) for c in ".,;!?")
    paragraph, heading, cell = b.tag in ("p", "blockquote", "pre", "figcaption"), b.tag in _HEADINGS, b.tag in _CELLS
    return [1.0, min(log1p(len(b.text)) / 6, 1.2), min(stops, 4) / 4, b.linked / len(b.text), paragraph, heading, cell, len(b.text) < 25 and not stops, min(place, 1 - place) < 0.05, "©" in b.text or "all rights reserved" in b.text.lower()]


def content_costs(blocks: list[Block], weights: np.ndarray = PRIOR) -> list[float]:
    """How much more it costs to call each block boilerplate than content; negative for boilerplate."""
    if not blocks:
        return []
    x = np.array([text_features(b, k / len(blocks)) for k, b in enumerate(blocks)], np.float64)
    return (np.clip(x @ weights, TEXT_LEAST, TEXT_MOST) + [b.mark for b in blocks]).tolist()


def fit_weights(x: np.ndarray, y: np.ndarray, hold: float = HOLD) -> np.ndarray:
    """Logistic regression by Newton steps, both classes counting alike, weights drawn to PRIOR; PRIOR without either class."""
    if not len(y) or y.all() or not y.any():
        return PRIOR
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + hold * (w - PRIOR)
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + hold * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def weak_label(b: Block) -> bool | None:
    """Content by a landmark, boilerplate by a landmark or word, or neither."""
    return False if b.chrome else True if b.article else None


def fit_on(pages: DataFrame, most: int = FIT_PAGES) -> np.ndarray:
    """Weights from at most `most` pages (those with the smallest hashes of page_id) and FIT_BLOCKS blocks of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for html in pdf["html"].tolist():
                blocks = blocks_of(html)
                some = range(0, len(blocks), -(-len(blocks) // FIT_BLOCKS) or 1)
                rows += [([*map(float, text_features(blocks[k], k / len(blocks)))], weak_label(blocks[k])) for k in some if weak_label(blocks[k]) is not None]
            yield pd.DataFrame(rows, columns=["x", "y"])

    order = F.xxhash64("page_id")
    sample = thinned(pages.where("html IS NOT NULL").select("page_id", "html"), most, "page_id").orderBy(order, "page_id", F.xxhash64("html")).limit(most)
    rows = sample.mapInPandas(run, "x array<double>, y boolean").collect()  # most * FIT_BLOCKS rows
    return fit_weights(np.array([r["x"] for r in rows]).reshape(-1, len(PRIOR)), np.array([r["y"] for r in rows], bool))


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source (content) side of the minimum cut; ties go to the sink side (Dinic's algorithm)."""
    n = len(costs)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(u: int, v: int, there: float, back: float) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for i, c in enumerate(costs):
        if c > 0:
            edge(s, i, c, 0.0)
        elif c < 0:
            edge(i, t, -c, 0.0)
    for u, v, w in edges:
        edge(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[u] < len(out[u]):
                e = out[u][place[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                place[u] += 1
            if place[u] < len(out[u]):
                path.append(e)
                u = to[e]
            elif u == s:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                place[u] += 1


def label(blocks: list[Block], weights: np.ndarray = PRIOR) -> list[bool]:
    """Whether each block is content."""
    edges = []
    latest: dict[tuple[int, int], int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR if blocks[i - 1].group == b.group else ACROSS))
        at = (b.parent, b.group)
        if at in latest:
            edges.append((latest[at], i, SIBLING))
        latest[at] = i
    return min_cut(content_costs(blocks, weights), edges)


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    """The page's content blocks joined by line ends; empty for null, empty or content-free pages."""
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, weights), strict=True) if keep)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html), by weights fitted on pages if none are given.

    Null html gives an empty text; null page_id and url stay null; repeated rows each give a row; an
    empty table gives none; other columns are ignored.
    """
    fitted = fit_on(pages) if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h, fitted) for h in pdf["html"].tolist()]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA)
