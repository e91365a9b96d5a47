import time

import numpy as np

from sievemill.llm import html_main


def test_hostile_pages_are_parsed_in_linear_time():
    n = 40_000
    pages = [
        "<a href=\"x " * n, "<a b='c\">" * n, "<div>" * n, "<div>" * n + "</span>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<p><b>" * n, "<a \">\" " * n + "'", "<" * n, "<!--" * n, "<script>" * n, "<p class=\"" * n + ">", "<table><td>" * n,
    ]
    start = time.time()
    for page in pages:
        html_main.parse(page)
    assert time.time() - start < 30


def test_deep_and_long_pages_keep_their_article():
    text = " ".join(f"Sentence {i} of a long article, with a few more words." for i in range(30_000))
    page = f"<nav><a href='/'>Home</a></nav>{'<div>' * 3000}<article><p>{text}</p></article>{'</div>' * 3000}<footer>end</footer>"
    blocks = html_main.parse(page)
    keep = html_main.label(blocks, html_main.features(blocks) @ html_main.PRIOR[:-1] + html_main.PRIOR[-1], 0.3, 0.2)
    assert [b.text for b, k in zip(blocks, keep, strict=True) if k] == [text]


def test_the_cut_turns_blocks_that_stand_alone():
    blocks = [html_main.Block("x", 0, 3, "p", 7, 0.0, 0) for _ in range(9)]
    logits = np.array([2.0] * 4 + [-0.2] + [2.0] * 4)
    assert html_main.label(blocks, logits, 0.3, 0.2) == [True] * 9
    assert html_main.label(blocks, logits, 0.0, 0.0) == [True] * 4 + [False] + [True] * 4


def test_repeated_rows_and_clashing_names(spark):
    page = "<article><p>One long sentence, which says a lot. Another one follows it here.</p></article><nav><a href='/'>Home</a></nav>"
    df = spark.createDataFrame([(1, "u", page, 5)] * 2 + [(None, None, page, 6)], "page_id long, url string, html string, n_chars int")
    got = html_main.main_text(df).collect()
    assert len(got) == 3 and {r.text for r in got} == {"One long sentence, which says a lot. Another one follows it here."}
