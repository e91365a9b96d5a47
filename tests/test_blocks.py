"""The page scanner against the standard library's parser, selectors, descriptions, and cards by spec."""

import json
import random
import time
from html.parser import HTMLParser

import pytest

from sievemill.sources import blocks

VOID = {"br", "img", "input", "hr", "meta", "link"}


class Tree(HTMLParser):
    """Elements by the standard library: (tag, attributes, pieces of text), nested as they are written."""

    def __init__(self, source):
        super().__init__()
        self.nodes, self.open = [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in reversed(attrs)}, []))
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in reversed(attrs)}, []))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[k]][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if data.split() and not any(self.nodes[n][0] in ("script", "style") for n in self.open):
            for n in self.open:
                self.nodes[n][2].append(" ".join(data.split()))


def test_elements_equal_the_standard_parser():
    rng = random.Random(6)
    bits = ["<div class='a b'>", "<div>", "</div>", "<p id=x>", "</p>", "<br>", "<br/>", "text ", " more&amp;&lt;é ", "<ul><li>", "</li>", "</ul>", "<script>if (a<b) '</p>'</script>", "<!-- <p> -->", "<a href=\"/j/1?a=1&amp;b=2\">", "</a>", "<span data-x='1' hidden>", "</span>", "<style>p{}</style>", "</b>"]
    for _ in range(400):
        source = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        page, tree = blocks.Page(source), Tree(source)
        mine = [(page.tag[n], page.attrs[n], page.text(n)) for n in range(1, len(page.tag)) if page.tag[n] not in ("script", "style")]
        assert mine == [(t, a, " ".join(x)) for t, a, x in tree.nodes if t not in ("script", "style")], source
        assert all(page.size(n) == len(page.text(n)) for n in range(len(page.tag)))


@pytest.mark.parametrize("source", ["<div>" * 60_000, "<p a='" * 60_000, "<!--" * 60_000, "<script>" * 60_000, "</x>" * 60_000, "<div>" * 20_000 + "</x>" * 20_000, "<a " * 100_000, "<" * 300_000])
def test_scan_is_linear(source):
    start = time.time()
    blocks.Page(source)
    assert time.time() - start < 5


def test_selectors():
    page = blocks.Page("<div id=m class='job x'><a href='/jobs/1' rel=next>A</a><ul><li><a class='next' href='/p2'>B</a></li></ul></div><a data-test='y' lang='en-GB'>C</a><section class='details-block job'>D</section>")
    found = lambda s: [page.text(n) for n in page.select(blocks.compile_selector(s))]
    assert found("a") == ["A", "B", "C"] and found("div a") == ["A", "B"] and found("div > a") == ["A"] and found("ul a.next, section.details-block.job") == ["B", "D"]
    assert found("a[href*='/jobs/']") == ["A"] and found("[rel=next]") == ["A"] and found("[data-test]") == ["C"] and found("[class*='details']") == ["D"] and found("#m li a") == ["B"]
    assert found("a[href^='/p']") == ["B"] and found("a[href$=\"1\"]") == ["A"] and found("[lang|=en]") == ["C"] and found("[class~=job]") == [page.text(1), "D"] and found("* > li") == ["B"] and found("a[href*='']") == []
    for bad in ("", ">a", "a:hover", "a[", "div >", "a,,b", "1+1", "a + b"):
        with pytest.raises(ValueError, match="selector"):
            blocks.compile_selector(bad)


def test_blocks_and_descriptions_keep_nested_elements(spark):
    long = "word " * 30
    pages = [
        (1, "https://x.test/a", f'<body><nav>{long}</nav><div class="job-description"><div>one {long}</div><p>rest</p></div><div class="job-description">short</div></body>', "old"),
        (2, "https://jobs.strict.test/a", f"<main>{long}</main><section class=own>short</section><section class=own>two {long}</section><section class=own>three {long}{long}</section>", "old"),
        (3, "https://x.test/c", f"<div class=menu>no</div><article>art {long}<aside>kept</aside></article><main>main {long}</main>", "old"),
        (4, "https://x.test/d", f'<div class="offer-body">{long}</div><script type="application/ld+json">{{"@type": "JobPosting", "description": "<b>ld</b> {long}{long}"}}</script>', "old"),
        (5, "https://x.test/e", "<p>tiny</p>", "old"), (6, None, None, "old"), (7, "https://x.test/g", "plain " * 20, None), (None, "https://sub.host.test/h", f"<main>{long}{long}</main><i id=q>q {long}</i>", "old"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, old string")
    rules = blocks.DescriptionRules(hosts={"host.test": ("#q",)}, strict={"strict.test": (".own",)})
    got = {r.page_id: r.text for r in blocks.page_descriptions(df, rules, known="old").collect()}
    w = long.strip()
    assert got == {1: f"one {w} rest", 2: f"two {w}", 3: f"art {w} kept", 4: f"ld {w} {w}", 5: "old", 6: "old", 7: ("plain " * 20).strip(), None: f"q {w}"}
    assert {r.page_id: len(r.text) for r in blocks.page_descriptions(df, rules, limit=60).collect()}[1] == 60
    rows = blocks.select_blocks(df, ["div", "section.own"]).where("page_id <= 2").orderBy("page_id", "selector", "node").collect()
    assert [(r.page_id, r.selector, r.tag, r.text[:5]) for r in rows] == [(1, 0, "div", "one w"), (1, 0, "div", "one w"), (1, 0, "div", "short"), (2, 1, "section", "short"), (2, 1, "section", "two w"), (2, 1, "section", "three")]
    assert blocks.page_descriptions(df.limit(0)).count() == 0 and blocks.select_blocks(df.limit(0), ["a"]).count() == 0


SPEC = blocks.SourceSpec("acme", "https://Jobs.Acme.test/jobs", "Acme", (r"/jobs/[^/?#]+",), ("a[href*='/jobs/']",), (".location",))
LISTING = """
<a href="/jobs/" >index</a>
<ul><li><a href="/jobs/one?utm_source=x#top">First job</a> <span class="location"> Town  A </span><time datetime="2024-05-01T10:00:00Z">May</time></li>
<li><a href="https://jobs.acme.test/jobs/one">First again</a></li>
<li><article><h3>ignored</h3><a href="/help">help</a><a href="../jobs/two"><h2>Second <b>job</b></h2> extra</a><p>Remote</p></article></li>
<li><article><a href="../jobs/six">Six</a><p>Remote</p><meta itemprop="datePosted" content="2024-05-03"></article></li>
<li><a href="https://other.test/jobs/three">Elsewhere</a></li><li><a href="/jobs/four"></a></li>
<li><div><a href="/jobs/five">Five</a> - Town B <i data-published-at="Fri, 03 May 2024 08:00:00 GMT"></i></div></li></ul>
<div class="pagination"><a class="next" href="/jobs?page=2">more</a></div><a rel="next" href="https://jobs.acme.test/jobs">here</a>
"""


def test_cards_by_spec(spark):
    df = spark.createDataFrame([(1, "https://jobs.acme.test/jobs", LISTING), (2, "https://jobs.acme.test/jobs", LISTING), (3, None, None), (4, "https://jobs.acme.test/x", "<a href='/jobs/solo'>" + "t" * 301 + "</a>")], "page_id long, url string, html string")
    cards = blocks.listing_cards(df, SPEC).where("page_id = 1").orderBy("at").collect()
    assert [(c.url, c.title, c.location, str(c.published_at)) for c in cards] == [
        ("https://jobs.acme.test/jobs/one", "First job", "Town A", "2024-05-01 10:00:00"), ("https://jobs.acme.test/jobs/two", "Second job", "extra", "None"), ("https://jobs.acme.test/jobs/six", "Six", "Remote", "2024-05-03 00:00:00"), ("https://jobs.acme.test/jobs/five", "Five", "Town B", "2024-05-03 08:00:00"),
    ]
    assert all(c.id.startswith("acme_") and c.company == "Acme" for c in cards)
    assert {r.page_id: r.next_url for r in blocks.next_pages(df, SPEC).collect()} == {1: "https://jobs.acme.test/jobs?page=2", 2: "https://jobs.acme.test/jobs?page=2", 3: None, 4: None}
    capped = blocks.SourceSpec("acme", "https://jobs.acme.test", "Acme", SPEC.job_paths, SPEC.cards, max_results=2)
    assert blocks.listing_cards(df, capped).groupBy("page_id").count().where("count <> 2").isEmpty()
    order = blocks.newest_first(blocks.listing_cards(df, SPEC)).where("page_id = 2").orderBy("place").collect()
    assert [c.title for c in order] == ["First job", "Second job", "Six", "Five"]  # one has no date
    order = blocks.newest_first(blocks.listing_cards(df, SPEC).where("published_at IS NOT NULL")).where("page_id = 2").orderBy("place").collect()
    assert [c.title for c in order] == ["Five", "Six", "First job"]
    assert blocks.listing_cards(df.limit(0), SPEC).count() == 0


@pytest.mark.parametrize(
    "wrong", [{"source": " "}, {"index_url": "jobs.test"}, {"job_paths": ()}, {"job_paths": ("(",)}, {"cards": ()}, {"cards": ("a:x",)}, {"max_results": 0}, {"max_title": 0}, {"next_pages": ("",)}]
)
def test_a_bad_spec_is_an_error(wrong):
    good = {"source": "s", "index_url": "https://x.test", "company": "c", "job_paths": ("/j",), "cards": ("a",)}
    blocks.SourceSpec(**good)
    with pytest.raises(ValueError):
        blocks.SourceSpec(**(good | wrong))


def test_json_objects_at_any_depth(spark, tmp_path):
    rng = random.Random(4)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([1, None, "x", True, 2.5, [], {}])
        if kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: value(depth - 1) for k in rng.sample(["title", "url", "job request", "z"], rng.randint(0, 4))}

    def walk(v, at=()):
        if isinstance(v, dict):
            if {"title", "job request"} <= set(v):
                yield list(at), v
            for n, k in enumerate(sorted(v)):
                yield from walk(v[k], (*at, n))
        elif isinstance(v, list):
            for n, x in enumerate(v):
                yield from walk(x, (*at, n))

    deep = {"title": 1, "job request": None}
    for _ in range(60):
        deep = [deep, {"title": deep}]
        deep = [deep[0]] if rng.random() < 0.9 else {"z": deep[0]}
    texts = [json.dumps(v) for v in [*(value(7) for _ in range(60)), deep]] + ["{broken", None, "", "3"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "page_id long, text string, at string").withColumnRenamed("at", "note")
    got = sorted((r.page_id, r.at, json.loads(r.j)) for r in blocks.json_objects(df, "text", ["title", "job request"], f"{tmp_path}/walk").selectExpr("page_id", "at", "to_json(found) AS j").collect())
    want = sorted((i, at, v) for i, t in enumerate(texts[:61]) for at, v in walk(json.loads(t)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[2] == w[2] for g, w in zip(got, want, strict=True)) and want
    assert blocks.json_objects(df.limit(0), "text", ["a"], f"{tmp_path}/none").count() == 0
