import itertools
import random

from sievemill.llm import html_main

PAGE = """<!doctype html><head><title>t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; line</h1><p>First <b>bo</b>ld   text.<br>More &eacute;.<p>Second one.<div class="advert">Buy now!</div><form><label>Mail</label><input></form><ul><li>Item one of it</ul>
<section id="comments"><p>Great article, I agree with all of it.</p></section></article><aside>Side bar</aside><!-- <p>gone</p> --><footer>&copy; us</footer></body>"""


def test_article_without_clutter(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <b>text < 5"), (None, "x", "plain words only, no markup at all.")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_main.main_text(df).collect()}
    assert got[1].text == "Head & line First bold text. More é. Second one. Item one of it"
    assert got[2].text == "" and got[3].text == "" and got[2].url is None
    assert got[1].n_chars == len(got[1].text) and len(got) == 5
    assert html_main.main_text(df.limit(0)).count() == 0


def test_minimum_cut_equals_brute_force():
    r = random.Random(4)
    for _ in range(150):
        n = r.randrange(1, 7)
        gain = [(r.random(), r.random()) for _ in range(n)]
        ties = [(a, b, r.random()) for a in range(n) for b in range(a) if r.random() < 0.5]
        flow = html_main.Flow(n + 2)
        for i, (a, b) in enumerate(gain):
            flow.add(n, i, a)
            flow.add(i, n + 1, b)
        for a, b, w in ties:
            flow.add(a, b, w, w)
        cost = lambda s: sum(b if x else a for x, (a, b) in zip(s, gain, strict=True)) + sum(w for a, b, w in ties if s[a] != s[b])  # noqa: B023, E731
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(flow.run(n, n + 1)[:n]) - best) < 1e-6


def test_pages_give_their_articles(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_main.query(spark, sf).collect()}
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert got[p.page_id] == want
