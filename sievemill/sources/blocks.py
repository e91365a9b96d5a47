"""Elements of pages by selectors: descriptions, cards of listing pages, and source specs that say which.

A page is scanned once, tag by tag, in linear time; patterns alone can't pair nested elements. The scan
runs in Arrow batches and gives raw strings; what is made of them (hosts, paths, canonical URLs, first
of each URL, titles, caps) are Columns and windows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.keys import canonical_url, stable_id
from sievemill.functions.text import squash
from sievemill.functions.times import parse_ts
from sievemill.sources.pages import _text, extract_jsonld

_TAG = re.compile(r"""<!--(?s:.)*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)>?""")
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}", re.I) for t in ("script", "style", "textarea", "title")}
_PART = re.compile(r"""([\w-]+|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]""")
#: Elements whose text is never seen.
SILENT = ("script", "style")
#: Elements left out of descriptions.
CLUTTER = ("script", "style", "nav", "header", "footer", "svg", "noscript", "iframe")
TITLES = ("h2, h3, h4, .title, .job-title, .titulo, strong, .regular-dark-blue-18",)


class Page:
    """The elements of a page in document order: tags, attributes, parents and the texts they span."""

    def __init__(self, source: str, silent: tuple[str, ...] = SILENT) -> None:
        self.tag, self.attrs, self.parent, self.end = ["#page"], [{}], [-1], [1]
        self.first, self.last, self.texts, self.chars = [0], [0], [], [0]
        at, open_, hush, names = 0, [0], 0, Counter()
        while at < len(source):
            found = _TAG.search(source, at)
            end = found.start() if found else len(source)
            if end > at and not hush:
                self._say(entities.unescape(source[at:end]))
            if not found:
                break
            at, name = found.end(), (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                while names[name]:
                    node = open_.pop()
                    names[self.tag[node]] -= 1
                    hush -= self.tag[node] in silent
                    self.last[node], self.end[node] = len(self.texts), len(self.tag)
                    if self.tag[node] == name:
                        break
                continue
            self.tag.append(name)
            self.attrs.append({k.lower(): entities.unescape(a or b or c) for k, a, b, c in reversed(_ATTR.findall(found[3]))})
            self.parent.append(open_[-1] if not hush else -2)
            self.first.append(len(self.texts))
            self.last.append(len(self.texts))
            self.end.append(len(self.tag))
            if name in _VOID or found[3].endswith("/"):
                continue
            if name in _RAW:
                end = _RAW[name].search(source, at)
                if name not in silent and not hush:
                    self._say(source[at : end.start() if end else len(source)])
                self.last[-1] = len(self.texts)
                at = end.start() if end else len(source)
                if end:
                    at = source.find(">", at) + 1 or len(source)
                if name in silent:
                    self.parent[-1] = -2
                continue
            open_.append(len(self.tag) - 1)
            names[name] += 1
            if name in silent:
                hush += 1
                self.parent[-1] = -2
        for n in open_:
            self.last[n], self.end[n] = len(self.texts), len(self.tag)

    def _say(self, text: str) -> None:
        text = " ".join(text.split())
        if text:
            self.texts.append(text)
            self.chars.append(self.chars[-1] + len(text))

    def text(self, node: int) -> str:
        return " ".join(self.texts[self.first[node] : self.last[node]])

    def size(self, node: int) -> int:
        """Length of ``text(node)``, without making it."""
        a, b = self.first[node], self.last[node]
        return self.chars[b] - self.chars[a] + max(0, b - a - 1)

    def above(self, node: int, name: str) -> int | None:
        """The nearest element called ``name`` around ``node``."""
        node = self.parent[node]
        while node > 0 and self.tag[node] != name:
            node = self.parent[node]
        return node if node > 0 else None

    def select(self, selector: Callable[[Page, int], bool], around: int = 0) -> Iterator[int]:
        """Elements below ``around`` that the compiled selector takes, in document order."""
        return (n for n in range(around + 1, self.end[around]) if self.parent[n] != -2 and selector(self, n))


def compile_selector(text: str) -> Callable[[Page, int], bool]:
    """A test for elements: names, ``#id``, ``.class``, ``[attribute]`` with ``=``, ``~=``, ``|=``, ``^=``, ``$=``, ``*=``, joined by blanks, ``>`` and commas.

    Anything else is an error.
    """
    ways = []
    for alternative in text.split(","):
        steps, direct = [], False
        words = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", alternative)
        if "".join("".join(words).split()) != "".join(alternative.split()):
            raise ValueError(f"not a selector: {text!r}")
        for word in words:
            if word == ">":
                direct = True
                continue
            tests, at = [], 0
            for part in _PART.finditer(word):
                if part.start() != at or (part[1] and at):
                    break
                at = part.end()
                tests.append(_test(*part.groups()))
            if at != len(word):
                raise ValueError(f"not a selector: {text!r}")
            steps.append((tests, direct))
            direct = False
        if not steps or direct or steps[0][1]:
            raise ValueError(f"not a selector: {text!r}")
        ways.append(steps[::-1])

    def takes(page: Page, node: int) -> bool:
        return any(_walk(page, node, steps) for steps in ways)

    return takes


def _walk(page: Page, node: int, steps: list) -> bool:
    tests, direct = steps[0]
    if not all(t(page.tag[node], page.attrs[node]) for t in tests):
        return False
    if len(steps) == 1:
        return True
    node = page.parent[node]
    while node > 0:
        if _walk(page, node, steps[1:]):
            return True
        if direct:
            return False
        node = page.parent[node]
    return False


def _test(tag, id_, class_, name, op, *values) -> Callable[[str, dict], bool]:
    if tag:
        return lambda t, a: tag == "*" or t == tag.lower()
    if id_:
        return lambda t, a: a.get("id") == id_
    if class_:
        return lambda t, a: class_ in a.get("class", "").split()
    name, value = name.lower(), next((v for v in values if v is not None), "")
    if op is None:
        return lambda t, a: name in a
    how = {
        "=": lambda x: x == value, "~=": lambda x: value in x.split(), "|=": lambda x: x == value or x.startswith(f"{value}-"),
        "^=": lambda x: bool(value) and x.startswith(value), "$=": lambda x: bool(value) and x.endswith(value), "*=": lambda x: bool(value) and value in x,
    }[op]
    return lambda t, a: name in a and how(a[name])


def compile_all(selectors: tuple[str, ...]) -> list[Callable[[Page, int], bool]]:
    return [compile_selector(s) for s in selectors]


def select_blocks(pages: DataFrame, selectors: list[str], silent: tuple[str, ...] = SILENT, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, selector, node, tag, attributes, text): one row per element that one of ``selectors`` takes.

    ``selector`` is the place in the list, ``node`` the place in the page; texts have single blanks.
    Elements inside ``silent`` ones are not seen. Null pages have no elements; repeated rows repeat.
    """
    tests = compile_all(tuple(selectors))
    kind = pages.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (page_id, n, node, page.tag[node], list(page.attrs[node].items()), page.text(node))
                for page_id, source in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True) for page in [Page(source or "", silent)]
                for n, test in enumerate(tests) for node in page.select(test)
            ]
            types = (batch.schema.field("page_id").type, pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "selector", "node", "tag", "attributes", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind.simpleString()}, selector int, node int, tag string, attributes map<string, string>, text string")


def json_objects(rows: DataFrame, value: str, having: list[str], path: str) -> DataFrame:
    """``rows`` with ``at`` and ``found``: every object within the JSON text ``value`` that holds all keys of ``having``.

    Objects are found at whatever depth, those within a found one too. The walk takes one level after the
    other: a level is a table below ``path``, made from the one before by ``variant_explode``, so a
    lost executor costs one level at most. ``at`` is the way to the object by places (members of an
    object count by the order of their names); it sorts an object before what it holds. Texts that are
    null or no JSON hold nothing.
    """
    spark, columns = rows.sparkSession, [c for c in rows.columns if c != value]
    rows.select(*columns, F.array().cast("array<int>").alias("at"), F.try_parse_json(F.col(value).cast("string")).alias("found")).where("found IS NOT NULL").write.mode("overwrite").parquet(f"{path}/level=0")
    kept = ", ".join(f"l.`{c}`" for c in columns)
    depth, hits = 0, []
    while not (level := spark.read.parquet(f"{path}/level={depth}")).isEmpty():
        has = F.lit(True)
        for key in having:
            has = has & F.variant_get("found", f"$['{key}']", "variant").isNotNull()
        hits.append(level.where(F.schema_of_variant("found").startswith("OBJECT") & has))
        below = spark.sql(f"SELECT {kept}{', ' if kept else ''}concat(l.at, array(e.pos)) AS at, e.value AS found FROM {{level}} l, LATERAL variant_explode(l.found) e", level=level)
        depth += 1
        below.write.mode("overwrite").parquet(f"{path}/level={depth}")
    return reduce(DataFrame.unionByName, hits) if hits else level


# Where public job pages keep their descriptions.
COMMON = (
    "[itemprop='description']", "[data-testid='job-description']", "[data-test='job-description']", "[data-qa='job-description']", ".job-description", ".jobDescription",
    ".offer-description", ".vacancy-description", ".posting-description", "[class*='job-description']", "[class*='offer-description']",
)


@dataclass(frozen=True)
class DescriptionRules:
    """Where descriptions stand: selectors by host, by ``strict`` host (nothing else counts there), and for all."""

    hosts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    strict: dict[str, tuple[str, ...]] = field(default_factory=dict)
    common: tuple[str, ...] = COMMON
    named_div: str = r"description|job-details|offer-body|details|job-description|vacancy-details"
    named_section: str = r"description|body|content"
    least: int = 50

    def __post_init__(self) -> None:
        for selectors in (*self.hosts.values(), *self.strict.values(), self.common):
            compile_all(selectors)
        re.compile(self.named_div), re.compile(self.named_section)


def _of_host(table: dict[str, list], host: str) -> list:
    return next((v for name, v in table.items() if host == name or host.endswith(f".{name}")), [])


def describe(rules: DescriptionRules) -> Callable[[str, str], tuple[str, bool]]:
    """A function of (html, host) that gives the description in a page and whether the host is strict."""
    hosts, strict = ({h: compile_all(s) for h, s in table.items()} for table in (rules.hosts, rules.strict))
    common, div, section = compile_all(rules.common), re.compile(rules.named_div, re.I), re.compile(rules.named_section, re.I)

    def longest(page: Page, tests: list) -> str:
        found = [n for n in dict.fromkeys(n for t in tests for n in page.select(t)) if page.size(n) >= rules.least]
        return page.text(max(found, key=page.size)) if found else ""

    def run(source: str, host: str) -> tuple[str, bool]:
        page, host = Page(source, CLUTTER), host.lower().split(":", 1)[0]
        if only := _of_host(strict, host):
            return next((page.text(n) for t in only for n in page.select(t) if page.size(n) > rules.least), ""), True
        if text := longest(page, _of_host(hosts, host)) or longest(page, common):
            return text, False
        named = [
            lambda p, n: p.tag[n] == "article", lambda p, n: p.tag[n] == "main", lambda p, n: p.tag[n] == "div" and any(map(div.search, p.attrs[n].get("class", "").split())),
            lambda p, n: p.tag[n] == "section" and any(map(section.search, p.attrs[n].get("class", "").split())), lambda p, n: p.tag[n] == "body",
        ]
        return page.text(next((n for t in named for n in page.select(t)), 0)), False

    return run


def page_descriptions(pages: DataFrame, rules: DescriptionRules | None = None, known: str | None = None, limit: int | None = 12_000) -> DataFrame:
    """(page_id, text): the best description of each page (page_id, url, html), nested elements whole.

    Of the host's selectors, then of the common ones, the longest element of ``least`` characters or
    more counts; else the first article, main, named div, named section or body; else the whole page. A
    longer JSON-LD description wins, but on ``strict`` hosts only the first element over ``least`` of
    their own selectors counts. ``limit`` characters are kept (None: all), the source's documented
    bound. A find of ``least`` characters or fewer leaves ``known``. Null pages are empty ones.
    """
    rules = rules or DescriptionRules()
    find = describe(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(h or "", host or "") for h, host in zip(batch["html"].to_pylist(), batch["host"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["known"], pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_())], names=["page_id", "known", "block", "strict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)
    blocks = pages.select("page_id", F.col("html").cast("string").alias("html"), host.alias("host"), (F.col(known) if known else F.lit("")).cast("string").alias("known")).mapInArrow(run, f"page_id {kind}, known string, block string, strict boolean")
    rows = blocks.join(extract_jsonld(pages).select("page_id", _text(F.coalesce("description", F.lit(""))).alias("ld")), "page_id", "left")
    ld = F.when(~F.col("strict") & (F.length("ld") >= rules.least) & (F.length("ld") > F.length("block")), F.col("ld"))
    best = F.coalesce(ld, "block")
    best = best if limit is None else F.substring(best, 1, limit)
    return rows.select("page_id", F.when(F.length(best) > rules.least, best).otherwise(F.coalesce("known", F.lit(""))).alias("text"))


@dataclass(frozen=True)
class SourceSpec:
    """What one source's listing pages look like: hosts and paths of postings, selectors of cards and their parts, caps.

    A spec that can't work (no host, broken pattern or selector, caps under one) is an error at once.
    """

    source: str
    index_url: str
    company: str
    job_paths: tuple[str, ...]
    cards: tuple[str, ...]
    locations: tuple[str, ...] = ()
    titles: tuple[str, ...] = TITLES
    next_pages: tuple[str, ...] = ("a[rel='next']", ".pagination a.next", "a.next")
    dates: tuple[str, ...] = ("time[datetime]", "[itemprop='datePosted']", "[data-published-at]", "[data-date-posted]")
    max_title: int = 300
    max_results: int | None = None
    no_location: str = "Ubicación no especificada"

    def __post_init__(self) -> None:
        if not self.source.strip() or not re.match(r"https?://[^/?#\s]+", self.index_url):
            raise ValueError(f"a spec needs a source and an index URL with a host: {self.source!r}, {self.index_url!r}")
        if not self.job_paths or not self.cards:
            raise ValueError(f"{self.source}: job_paths and cards must not be empty")
        if self.max_title < 1 or (self.max_results is not None and self.max_results < 1):
            raise ValueError(f"{self.source}: caps must be positive")
        for pattern in self.job_paths:
            try:
                re.compile(pattern)
            except re.error as exc:
                raise ValueError(f"{self.source}: bad pattern {pattern!r}: {exc}") from exc
        for selectors in (self.cards, self.locations, self.titles, self.next_pages, self.dates):
            compile_all(selectors)

    @property
    def host(self) -> str:
        return re.match(r"https?://([^/?#\s]+)", self.index_url)[1].lower()


_DATES = ("datetime", "content", "data-published-at", "data-date-posted")
_CARD = "page_id {kind}, url string, at int, href string, title string, location string, dates array<string>, next array<string>"


def _cards(spec: SourceSpec) -> Callable[[str, str], Iterator[tuple]]:
    """A function of (html, url) that gives the raw cards of a page, and one row of its next links."""
    cards, places, titles, nexts, dates = map(compile_all, (spec.cards, spec.locations, spec.titles, spec.next_pages, spec.dates))
    anchor = compile_selector("a[href]")
    own = re.compile("|".join(f"(?:{p})" for p in spec.job_paths), re.I)

    def posting(link: str) -> bool:
        found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?(?://([^/?#]*))?([^?#]*)", link)
        return (not found[1] or found[1].lower() == spec.host) and bool(own.search(found[2]))

    def run(source: str, url: str) -> Iterator[tuple]:
        page = Page(source)
        first = lambda tests, around: next((n for t in tests for n in page.select(t, around)), None)
        for at, link in enumerate(n for t in cards for n in page.select(t)):
            href = page.attrs[link].get("href", "").strip()
            if not href or not posting(full := _join(url, href)):
                continue
            card = link
            if first(places, link) is None and first(titles, link) is None:
                card = next((n for name in ("article", "li", "div") if (n := page.above(link, name)) is not None), link)
            # The first posting linked in the card gives the title, not a link beside it.
            named = link if card == link else next((n for n in page.select(anchor, card) if posting(_join(url, page.attrs[n].get("href", "")))), link)
            head = first(titles, named)
            title = page.text(named if head is None else head)
            place = next((t for test in places for n in page.select(test, card) if (t := page.text(n))), "")
            if not place:
                place = page.text(card)
                place = place[len(title) :].strip(" -|·") if title and place.startswith(title) else place
                place = place[:300]
            said = [page.attrs[n].get(a) for n in (card, *(n for t in dates for n in page.select(t, card))) for a in _DATES]
            yield at, full, title, place, [s for s in said if s], None
        yield -1, None, None, None, None, [_join(url, h) for t in nexts if (n := next(page.select(t), None)) is not None and (h := page.attrs[n].get("href", "").strip())]

    return run


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""


def _raw_cards(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    find = _cards(spec)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page_id, url, *card) for page_id, url, source in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True) for card in find(source or "", url or "")]
            types = (batch.schema.field("page_id").type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "at", "href", "title", "location", "dates", "next"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _CARD.format(kind=kind))


def listing_cards(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """(page_id, at, source, id, url, title, company, location, published_at): one row per posting that a page links to.

    ``pages`` (page_id, url, html) are listing pages of one source. A link counts once per page, by
    its canonical URL and in document order, if it stays on the spec's host and its path is a posting's. Title,
    place and date come from the card around it; titles have 1 to ``max_title`` characters. With
    ``max_results`` a page keeps its first ones. Null pages have no cards.
    """
    raw = _raw_cards(pages, spec).where("at >= 0").withColumn("url", canonical_url(F.col("href"), "tracked"))
    firsts = raw.groupBy("page_id", "url").agg(F.min_by(F.struct("at", "title", "location", "dates"), "at").alias("card")).select("page_id", "url", "card.*")
    rows = firsts.where(F.length("title").between(1, spec.max_title))
    if spec.max_results is not None:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).where(F.col("place") <= spec.max_results)
    place = F.coalesce(F.nullif(squash(F.col("location")), F.lit("")), F.lit(spec.no_location))
    company = F.lit(spec.company)
    dates = F.array_compact(F.transform("dates", parse_ts))
    return rows.select("page_id", "at", F.lit(spec.source).alias("source"), stable_id(F.lit(spec.source), F.col("url"), F.col("title"), company, place).alias("id"), "url", "title", company.alias("company"), place.alias("location"), F.try_element_at(dates, F.lit(1)).alias("published_at"))


def next_pages(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """(page_id, next_url): the first next link of each page that doesn't lead back to it, or null."""
    rows = _raw_cards(pages, spec).where("at < 0")
    here = canonical_url(F.col("url"), "tracked")
    links = F.filter(F.transform("next", lambda u: canonical_url(u, "tracked")), lambda u: (u != here) & (u != ""))
    return rows.select("page_id", F.try_element_at(links, F.lit(1)).alias("next_url"))


def newest_first(cards: DataFrame, by: Column | str = "page_id") -> DataFrame:
    """Cards with ``place``: newest first where every card of the page has a date, else in page order."""
    rows = cards.withColumn("dated", F.count_if(F.col("published_at").isNull()).over(Window.partitionBy(by)) == 0)
    newest = F.desc(F.when(F.col("dated"), F.col("published_at")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(newest, "at"))).drop("dated")
