"""Main text of web pages by minimum cut.

A page is parsed into text blocks. A classifier gives each block the cost of calling it content or boilerplate; these
become its capacities to source and sink. Blocks that follow each other, and blocks under one element (through a node
for that element, which is tied to the next one up), are joined by smoothness edges. The minimum cut is the cheapest
labelling; the content blocks are the text.

The classifier is a logistic regression over the block's shape and what its ancestors are named. It starts from the
prior weights below and is fitted on blocks that the page itself labels (inside ``article``, ``main`` or inside
``nav``, ``footer``, …), so that what a collection never shows keeps its prior.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import released

#: Most pages and blocks that the classifier is fitted on.
SAMPLE_PAGES, SAMPLE_BLOCKS = 500, 20_000
#: Smoothness: neighbours under one element, other neighbours, a block and its element, an element and the next up.
NEXT_SAME, NEXT_OTHER, UNDER, UP = 0.8, 0.3, 0.5, 0.3
CLIP, SCALE = 12.0, 1000
PRIOR_PULL = 10.0

#: Fixed values of the format: elements by their role in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg annotation annotation-xml iframe object select textarea "
                   "button canvas audio video datalist".split())
FOREIGN = frozenset(("svg", "math"))  # may close themselves
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title html head".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
                  "search section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead", "tfoot"),
             "tfoot": ("tr", "td", "th", "tbody", "thead"), "thead": ("caption",)}
BARRIER = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

NAMED = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap skip",
    "footer": "footer foot contentinfo copyright colophon",
    "header": "header masthead banner topbar logo",
    "side": "aside sidebar widget related recommended recommendations promo complementary rail teaser trending",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors adsense dfp",
    "notice": "notice cookie cookies consent gdpr popup modal alert newsletter subscribe subscription paywall dialog",
    "comments": "comment comments reply replies respond discussion disqus feedback reviews",
    "form": "form login signup register search fieldset searchbox",
    "share": "share sharing social toolbar follow",
}
WORD_GROUP = {word: group for group, words in NAMED.items() for word in words.split()}
TAG_GROUP = {"nav": "menu", "menu": "menu", "footer": "footer", "header": "header", "aside": "side", "form": "form",
             "fieldset": "form", "dialog": "notice", "search": "form"}
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article articlebody content post entry story main".split())
GROUPS = (*NAMED, "hidden", "content tag", "content name")
SHAPE = ("one", "words", "links", "sentence end", "stops", "heading", "list item", "rights")
FEATURES = SHAPE + GROUPS
#: Weights before fitting, in the order of FEATURES; positive speaks for content.
PRIOR = np.array([-1.0, 0.6, -4.0, 0.8, 1.0, 0.5, -0.8, -3.0] + [-10.0] * 8 + [-6.0] + [-6.0, 4.0, 1.5])
_STOPS = re.compile(r"[.,;:!?]")
_RIGHTS = re.compile(r"©|\(c\)\s|all rights reserved", re.I)
_TOKENS = re.compile(r"[^a-z]+")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    flags: frozenset[str]


@dataclass(slots=True)
class Block:
    element: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


_NO_FLAGS: frozenset[str] = frozenset()


class Page(HTMLParser):
    """Blocks of a page in order, and the elements they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", -1, _NO_FLAGS)]
        self.blocks: list[Block] = []
        self._stack = [0]
        self._count: dict[str, int] = {}
        self._current: Block | None = None

    def _flags(self, tag: str, attrs: list, above: frozenset[str]) -> frozenset[str]:
        own = set()
        if tag in CONTENT_TAGS:
            own.add("content tag")
        if tag in TAG_GROUP:
            own.add(TAG_GROUP[tag])
        if tag in HEADINGS:
            own.add("heading")
        elif tag == "li":
            own.add("list item")
        elif tag == "a":
            own.add("link")
        if attrs and tag not in ("html", "body"):
            named, content = set(), False
            for key, value in attrs:
                if key in ("class", "id", "role", "itemprop") and value:
                    for token in _TOKENS.split(value.lower()):
                        if token in WORD_GROUP:
                            named.add(WORD_GROUP[token])
                        content |= token in CONTENT_WORDS
                elif key == "hidden" or key == "aria-hidden" and value == "true" or \
                        key == "style" and value and "display:none" in value.replace(" ", "").lower():
                    own.add("hidden")
            if content and not named:
                own.add("content name")
            elif not content:
                own |= named
        if "content tag" in above:
            own.discard("header")  # an article's own head
        return above | own if own - above else above

    def _end_block(self) -> None:
        self._current = None

    def _pop_to(self, at: int) -> None:
        for k in self._stack[at:]:
            self._count[self.elements[k].tag] -= 1
        del self._stack[at:]
        self._end_block()

    def _close(self, tags: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        if not any(self._count.get(t) for t in tags):
            return
        found = None
        for at in range(len(self._stack) - 1, 0, -1):
            tag = self.elements[self._stack[at]].tag
            if tag in tags:
                found = at
            elif tag in barrier or tag in ("table", "td", "th") and tag not in tags and "p" in tags or tag == "table":
                break
        if found is not None:
            self._pop_to(found)

    def _end_head(self) -> None:
        """A head that was left open ends at the first thing that cannot stand in it."""
        if self._count.get("head") and self.elements[self._stack[-1]].tag == "head":
            self._close(("head",))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in BLOCK:
            self._end_block()
            self._close(("p",))
            if tag in CLOSED_BY:
                self._close(CLOSED_BY[tag], BARRIER.get(tag, ()))
        if tag == "br" and self._current is not None:
            self._current.pieces.append(" ")
        if tag in VOID:
            return
        above = self._stack[-1]
        if tag == "body" and self._count.get("head"):
            self._close(("head",))
            above = self._stack[-1]
        self.elements.append(Element(tag, above, self._flags(tag, attrs, self.elements[above].flags)))
        self._stack.append(len(self.elements) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in FOREIGN or tag not in VOID and tag not in BLOCK and tag not in UNSEEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_block()
        if not self._count.get(tag):
            return
        for at in range(len(self._stack) - 1, 0, -1):
            if self.elements[self._stack[at]].tag == tag:
                for k in self._stack[at:]:
                    self._count[self.elements[k].tag] -= 1
                del self._stack[at:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if any(self._count.get(t) for t in UNSEEN if t in self._count):
            return
        if self._current is None:
            if not data.strip():
                return
            at = self._stack[-1]
            while at and self.elements[at].tag not in BLOCK:
                at = self.elements[at].parent
            self._current = Block(at)
            self.blocks.append(self._current)
        self._current.pieces.append(data)
        if "link" in self.elements[self._stack[-1]].flags:
            self._current.linked += len(data.strip())


def parsed(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    for block in page.blocks:
        block.text = " ".join("".join(block.pieces).split())
    page.blocks = [b for b in page.blocks if b.text]
    return page


def described(page: Page) -> np.ndarray:
    """A row of features per block."""
    out = np.zeros((len(page.blocks), len(FEATURES)))
    for k, block in enumerate(page.blocks):
        text, flags = block.text, page.elements[block.element].flags
        words = text.count(" ") + 1
        out[k, :len(SHAPE)] = (
            1, log1p(words), min(1, block.linked / len(text)), text[-1] in ".!?…\"'”»",
            min(1, 5 * len(_STOPS.findall(text)) / words), "heading" in flags, "list item" in flags,
            _RIGHTS.search(text) is not None)
        out[k, len(SHAPE):] = [g in flags for g in GROUPS]
    return out


def own_label(flags: frozenset[str]) -> int | None:
    """What the page itself says of a block: 1 content, 0 boilerplate, None nothing."""
    if flags & NAMED.keys():
        return 0
    return 1 if "content tag" in flags else None


def fitted(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the logistic regression pulled towards the prior, by Newton steps."""
    weights = PRIOR.copy()
    if not len(labels):
        return weights
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + PRIOR_PULL * (weights - PRIOR)
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + PRIOR_PULL * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return weights


class Flow:
    """Maximum flow by shortest augmenting layers; nodes 0 and 1 are source and sink."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def edge(self, a: int, b: int, capacity: int, back: int = 0) -> None:
        for u, v, c in ((a, b, capacity), (b, a, back)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.left.append(c)

    def _levels(self) -> list[int]:
        level, queue = [-1] * len(self.out), deque((0,))
        level[0] = 0
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                v = self.to[e]
                if self.left[e] and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def source_side(self) -> list[bool]:
        """Push all flow; the nodes still reached from the source."""
        while (level := self._levels())[1] >= 0:
            tried, path, u = [0] * len(self.out), [], 0
            while True:
                if u == 1:
                    push = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= push
                        self.left[e ^ 1] += push
                    first = next(k for k, e in enumerate(path) if not self.left[e])
                    u = self.to[path[first] ^ 1]
                    del path[first:]
                elif tried[u] < len(self.out[u]):
                    e = self.out[u][tried[u]]
                    if self.left[e] and level[self.to[e]] == level[u] + 1:
                        path.append(e)
                        u = self.to[e]
                    else:
                        tried[u] += 1
                elif path:
                    u = self.to[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break
        return [v >= 0 for v in level]


def _containers(page: Page) -> list[int]:
    """For each element the nearest one, itself included, that holds two or more blocks or elements with blocks."""
    units = [0] * len(page.elements)
    for block in page.blocks:
        units[block.element] += 1
    for k in range(len(units) - 1, 0, -1):
        if units[k]:
            units[page.elements[k].parent] += 1
    nearest = [0] * len(units)
    for k in range(1, len(units)):
        nearest[k] = k if units[k] > 1 else nearest[page.elements[k].parent]
    return nearest


def content_blocks(page: Page, weights: np.ndarray) -> list[bool]:
    """The cheapest labelling of the page's blocks."""
    n = len(page.blocks)
    nearest = _containers(page)
    own = [nearest[b.element] for b in page.blocks]
    node = {}
    for k in own:
        while k not in node:
            node[k] = n + 2 + len(node)
            k = nearest[page.elements[k].parent] if k else 0
    flow = Flow(n + 2 + len(node))
    for k, score in enumerate(np.clip(described(page) @ weights, -CLIP, CLIP)):
        flow.edge(0, k + 2, round(SCALE * log(1 + exp(score))))
        flow.edge(k + 2, 1, round(SCALE * log(1 + exp(-score))))
        flow.edge(k + 2, node[own[k]], round(SCALE * UNDER), round(SCALE * UNDER))
        if k:
            c = round(SCALE * (NEXT_SAME if own[k] == own[k - 1] else NEXT_OTHER))
            flow.edge(k + 1, k + 2, c, c)
    for k in node:
        if k:
            flow.edge(node[k], node[nearest[page.elements[k].parent]], round(SCALE * UP), round(SCALE * UP))
    return flow.source_side()[2:n + 2]


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    """The content blocks, each with single spaces, one per line; empty if there are none."""
    page = parsed(html or "")
    if not page.blocks:
        return ""
    return "\n".join(b.text for b, c in zip(page.blocks, content_blocks(page, weights), strict=True) if c)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, labels = [np.zeros((0, len(FEATURES)))], []
        for html in batch.column(0).to_pylist():
            page = parsed(html or "")
            known = [own_label(page.elements[b.element].flags) for b in page.blocks]
            rows.append(described(page)[[k is not None for k in known]])
            labels += [k for k in known if k is not None]
        flat = np.concatenate(rows)
        cut = pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.ListArray.from_arrays(
            cut, pa.array(flat.ravel()))], ["label", "row"])


def learn(pages: DataFrame) -> np.ndarray:
    """Classifier weights from at most SAMPLE_PAGES ids (smallest hashes) and SAMPLE_BLOCKS of their blocks."""
    chosen = (pages.select("page_id").filter("page_id IS NOT NULL").distinct()
              .orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES))
    rows = (pages.select("page_id", "html").join(F.broadcast(chosen), "page_id", "left_semi").select("html")
            .mapInArrow(released(_labelled), "label int, row array<double>"))
    got = rows.orderBy(F.xxhash64("row"), "label").limit(SAMPLE_BLOCKS).toArrow().combine_chunks()
    labels = got["label"].to_numpy()
    flat = got["row"].combine_chunks().flatten().to_numpy() if len(labels) else np.zeros(0)
    return fitted(flat.reshape(len(labels), len(FEATURES)), labels)


def with_main_text(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; a null or empty html, or one without content, has empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py(), weights) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        released(run), "page_id long, url string, text string, n_chars long")
