import pytest

from sievemill.llm import html_main

STORY = "<h1>Head line of it</h1><p>First long sentence of the story, with words. Second one follows it.</p><p>Third sentence ends the story here. It is enough.</p>"
TEXT = "Head line of it First long sentence of the story, with words. Second one follows it. Third sentence ends the story here. It is enough."
REST = "<aside>Side bar</aside><footer>All rights</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title></head><body class='single-post has-sidebar comments-open'><article>{STORY}</article>{REST}</body></html>",
        f"<html><head><title>t</title></head><body id=sidebar><div class='page sidebar'><article>{STORY}</article></div>{REST}</body></html>",
        f"<html><head></head><body><div class='content with-sidebar'>{STORY}</div>{REST}</body></html>",
        f"<html><head><title>t</title><meta charset=utf-8><body><main>{STORY}</main>{REST}</body></html>",
        f"<head><title>t</title><link rel=x href=y><main>{STORY}</main>{REST}",
        f"<main>{STORY}</main><div class='related'><article><a href='/x'>Other head</a></article></div><div id='comments'><p>I agree.</p></div>{REST}",
        f"<article>{STORY}<section id='comments'><article><p>I agree.</p></article></section></article><div class='cookie-notice'><div class='text'>We use cookies</div></div>{REST}",
    ],
)
def test_articles_below_named_elements_and_open_heads(spark, page):
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_main.main_text(df).first().text == TEXT
