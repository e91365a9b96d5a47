"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier, trained here on a bounded sample of
pages whose own markup tells content from boilerplate, gives each block the cost of calling it
content or boilerplate; these are its capacities to source and sink. Neighbouring blocks and
blocks below the same element are tied by smoothness edges. The minimum cut, found by maximum
flow, separates the article from the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import settle, table

# HTML elements by role, and words of class and id attributes.
SILENT = frozenset("script style noscript template svg math iframe object canvas select option textarea button title head audio video map".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTENT_TAGS = frozenset("article main".split())
CLUTTER_TAGS = frozenset("nav aside footer form menu dialog search".split())
CONTENT_WORDS = frozenset("article content entry post story main body text maintext articlebody".split())
CLUTTER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget widgets footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social comment comments respond reply replies disqus discussion related recommended trending pagination pager copyright legal disclaimer toolbar tags".split()
)
#: Words that make a name tell of a page's layout or state, as in has-sidebar or comments-open.
STATE_WORDS = frozenset("has with no without open closed".split())
HEAD_TAGS = frozenset("html head title base link meta style script noscript template".split())
LINK_TAGS = frozenset(["a"])

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    """A run of text between block boundaries: its text, surroundings and link share."""

    __slots__ = ("text", "region", "depth", "tag", "parent", "linked", "naming")

    def __init__(self, text, region, depth, tag, parent, linked, naming):
        self.text, self.region, self.depth, self.tag, self.parent, self.linked, self.naming = text, region, depth, tag, parent, linked, naming


def _attributes(raw: str) -> tuple[int, int, bool]:
    """(content word seen, clutter word seen, hidden) of an element's attributes."""
    good = bad = 0
    hidden = False
    if raw and not raw.isspace():
        for m in _NAMES.finditer(raw):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden":
                hidden = hidden or raw[m.start() - 1 : m.start()].isspace()
            elif name == "aria-hidden":
                hidden = hidden or value == "true"
            else:
                for part in value.split():
                    words = set(_WORD.findall(part))
                    bad = bad or bool(words & CLUTTER_WORDS and not words & STATE_WORDS)
                    good = good or bool(words & CONTENT_WORDS and not words & STATE_WORDS)
                if name == "role":
                    bad = bad or value in ("navigation", "banner", "contentinfo", "complementary", "search")
    return int(good and not bad), int(bad), hidden


class TagEnds:
    """Finds where tags end; quoted > don't count. Linear over a page, whatever its quotes.

    A quote that nothing closes is an ordinary character. Once a tag runs to the page's end, it and
    all later ones end at the next >.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.loose = page, {q: page.rfind(q) for q in "\"'"}, False

    def find(self, at: int) -> int:
        start = at
        while not self.loose:
            m = _STOP.search(self.page, at)
            if not m:
                self.loose = True
            elif m[0] == ">":
                return m.start()
            else:
                at = m.end() if m.start() == self.last[m[0]] else self.page.find(m[0], m.end()) + 1
        return self.page.find(">", start)


class OpenElements:
    """The stack of open elements, with what has to be known of it in constant time.

    An element is (name, region, naming, silent, serial, put at -1 by names alone); region 2 is an
    article below such names.
    """

    def __init__(self) -> None:
        self.stack: list[tuple] = [("", 0, 0, False, 0, False)]
        self.blocks, self.count, self.inline = [0], Counter(), [Counter()]

    def push(self, element: tuple) -> None:
        name = element[0]
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
            self.inline.append(Counter())
        else:
            self.inline[-1][name] += 1
        self.count[name] += 1
        self.stack.append(element)

    def pop(self) -> None:
        name = self.stack.pop()[0]
        self.count[name] -= 1
        if name in BLOCKS:
            self.blocks.pop()
            self.inline.pop()
        else:
            self.inline[-1][name] -= 1

    def close(self, name: str) -> None:
        """End ``name`` and what is open inside it; an inline element only within its block."""
        if (self.count if name in BLOCKS else self.inline[-1])[name] > 0:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def block(self) -> tuple:
        return self.stack[self.blocks[-1]]


def parse(page: str) -> list[Block]:
    """The text blocks of a page in order.

    ``region`` is 1 inside an article, -1 inside a menu, footer, form, notice and the like, by the
    nearest such element, and 0 elsewhere; ``naming`` says the same of class and id words alone.
    Names of html and body count for nothing. Below an element that only its names put at -1,
    outside any article, an article or main is 1 again if it has at least as much text as what is 1
    anyway (it can be a teaser otherwise, and is 0), and elements named as content are 0.
    """
    out: list[Block] = []
    opened = OpenElements()
    stack, ends = opened.stack, TagEnds(page)
    text: list[str] = []
    linked = in_link = serial = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join("".join(text).split())
            if said:
                top = stack[-1]
                block = opened.block()
                out.append(Block(said, top[1], len(stack), block[0], block[4], min(1.0, linked / len(said)), top[2]))
            text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and raw and not raw.isspace():
            opened.pop()
        if raw and not stack[-1][3]:
            raw = html.unescape(raw)
            text.append(raw)
            if in_link:
                linked += len(raw.strip())

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt)
        stop = ends.find(m.end()) if m else -1
        if stop < 0:
            say("<")
            at = lt + 1
            continue
        at, name, attributes = stop + 1, m[2].lower(), page[m.end() : stop]
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCKS:
                flush()
            opened.close(name)
            continue
        if stack[-1][0] == "head" and name not in HEAD_TAGS:
            opened.pop()
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end if not close else close.end()
            if name in ("textarea", "iframe", "noscript"):
                text.append(" ")
            continue
        if name == "br":
            say("\n")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            if opened.block()[0] == "p":
                # An open paragraph ends where the next block begins, with what is open inside it.
                opened.close("p")
            if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == name:
                opened.pop()
        if name == "a":
            in_link += 1
        if attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        _, region, naming, silent, _, by_name = stack[-1]
        good, bad, hidden = _attributes(attributes)
        if name in ("html", "body"):
            good = bad = 0
        if name in CLUTTER_TAGS or name == "header" and region < 1:
            region, by_name = -1, False
        elif bad:
            by_name = by_name or region != -1
            region = naming = -1
        elif region != -1 and (name in CONTENT_TAGS or good):
            region = max(1, region)
            naming = 1 if good else naming
        elif by_name and (name in CONTENT_TAGS or good) and not opened.count["article"]:
            region, naming, by_name = (2, good, False) if name in CONTENT_TAGS else (0, 0, False)
        serial += 1
        opened.push((name, region, naming, silent or hidden or name in SILENT, serial, by_name))
    flush()
    sure, found = (sum(len(b.text) for b in out if b.region == k) for k in (1, 2))
    for b in out:
        if b.region == 2:
            b.region = int(found >= sure)
    return out


FEATURES = ("region_content", "region_clutter", "naming_content", "naming_clutter", "linked", "log_chars", "stops", "heading", "item", "paragraph", "start", "end")


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block, in the order of ``FEATURES``."""
    n = len(blocks)
    return np.array(
        [
            (
                b.region == 1, b.region == -1, b.naming == 1, b.naming == -1, b.linked, math.log1p(len(b.text)) / 6, min(3, sum(map(b.text.count, ".!?"))) / 3,
                b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "dd", "dt", "td"), b.tag in ("p", "blockquote", "pre"), max(0.0, 1 - i / 5), max(0.0, 1 - (n - 1 - i) / 3),
            )
            for i, b in enumerate(blocks)
        ],
        np.float64,
    ).reshape(n, len(FEATURES))


class Flow:
    """Maximum flow by breadth-first levels and blocking flows (Dinic), on lists."""

    def __init__(self, nodes: int) -> None:
        self.to: list[int] = []
        self.free: list[float] = []
        self.of: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.of[a].append(len(self.to))
        self.of[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.free += (there, back)

    def reach(self, source: int) -> list[int]:
        level = [-1] * len(self.of)
        level[source] = 0
        todo = deque([source])
        while todo:
            v = todo.popleft()
            for e in self.of[v]:
                w = self.to[e]
                if self.free[e] > 1e-9 and level[w] < 0:
                    level[w] = level[v] + 1
                    todo.append(w)
        return level

    def run(self, source: int, sink: int) -> list[bool]:
        """Saturate the graph; true for the nodes on the source's side of the minimum cut."""
        while (level := self.reach(source))[sink] >= 0:
            nxt = [0] * len(self.of)
            path: list[int] = []
            v = source
            while True:
                if v == sink:
                    push = min(self.free[e] for e in path)
                    for e in path:
                        self.free[e] -= push
                        self.free[e ^ 1] += push
                    cut = next(i for i, e in enumerate(path) if self.free[e] <= 1e-9)
                    v = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.of[v]
                while nxt[v] < len(edges):
                    e = edges[nxt[v]]
                    if self.free[e] > 1e-9 and level[self.to[e]] == level[v] + 1:
                        break
                    nxt[v] += 1
                if nxt[v] < len(edges):
                    path.append(edges[nxt[v]])
                    v = self.to[path[-1]]
                elif v == source:
                    break
                else:
                    level[v] = -1
                    v = self.to[path.pop() ^ 1]
        return [x >= 0 for x in self.reach(source)]


def label(blocks: list[Block], logits: np.ndarray, adjacent: float, related: float) -> list[bool]:
    """True for the blocks on the content side of the minimum cut."""
    n = len(blocks)
    if not n:
        return []
    flow, source, sink = Flow(n + 2), n, n + 1
    for i, x in enumerate(logits.tolist()):
        # Cost of calling the block boilerplate, and of calling it content: negative log likelihoods.
        flow.add(source, i, max(x, 0.0) + math.log1p(math.exp(-abs(x))))
        flow.add(i, sink, max(-x, 0.0) + math.log1p(math.exp(-abs(x))))
    last_below: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            # The nearer two neighbours are in the tree, the dearer it is to part them.
            steps = abs(b.depth - blocks[i - 1].depth) + (b.parent != blocks[i - 1].parent)
            flow.add(i - 1, i, adjacent / (1 + steps), adjacent / (1 + steps))
        if (before := last_below.get(b.parent)) is not None and before != i - 1:
            flow.add(before, i, related, related)
        last_below[b.parent] = i
    return flow.run(source, sink)[:n]


#: Weights of FEATURES and intercept where the pages have no examples of both kinds to train on.
PRIOR = np.array([4.0, -6.0, 2.0, -4.0, -4.0, 1.5, 1.0, 0.5, -0.5, 1.0, 0.0, 0.0, -1.5])


def train(pages: DataFrame, html_col: str, sample_pages: int) -> np.ndarray:
    """Weights and intercept of the block classifier, from at most about ``sample_pages`` pages.

    Blocks in an article are examples of content, those in menus, footers, forms and the like of
    boilerplate. Every block is also shown without its region, and without region and names, so
    that no single sign decides alone: text, links, tags and names have to tell a block by
    themselves as far as they can. ``PRIOR`` stands in only where one kind is missing.
    """
    n = pages.count()
    share = min(1.0, sample_pages / max(1, n))
    picked = pages.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for page in batch["html"].to_pylist():
                blocks = parse(page or "")
                x = features(blocks)
                for row, b in zip(x, blocks, strict=True):
                    if b.region:
                        unplaced, unnamed = row.copy(), row.copy()
                        unplaced[:2], unnamed[:4] = 0, 0
                        rows += [row, unplaced, unnamed]
                        labels += [float(b.region == 1)] * 3
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "label": pa.array(labels, pa.float64())})

    examples = settle(picked.mapInArrow(run, "x array<double>, label double"), "html-examples")
    if examples.select("label").distinct().count() < 2:
        return PRIOR
    model = LogisticRegression(featuresCol="v", maxIter=40, regParam=0.01).fit(examples.select(array_to_vector("x").alias("v"), "label"))
    return np.append(model.coefficients.toArray(), model.intercept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = 2000, adjacent: float = 0.3, related: float = 0.2) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    ``text`` joins the blocks on the content side of the cut by one space, in page order, with
    references decoded and white space inside a block as one space. Null and empty pages, and
    pages without content, give the empty text; null ids and urls stay null; repeated rows give
    repeated results; an empty table gives none; other columns are ignored. The classifier is
    trained on about ``sample_pages`` pages; every page is labelled over its whole length.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    weights = train(rows.select("html"), "html", sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page in batch["html"].to_pylist():
                blocks = parse(page or "")
                keep = label(blocks, features(blocks) @ weights[:-1] + weights[-1], adjacent, related)
                texts.append(" ".join(b.text for b, k in zip(blocks, keep, strict=True) if k))
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
