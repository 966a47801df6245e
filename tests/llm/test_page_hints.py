"""Names of elements round an article do not condemn it."""

from __future__ import annotations

import pytest

from recallium.llm.html_text import main_text

BODY = "The storm came over the hills in the night and it was the first of the year that took the roofs of the town with it."
SIDE = "This is the text of the side column and it has as many of the small words as the article itself has in it."


@pytest.mark.parametrize("page", [
    '<body><div class="layout with-sidebar"><article><p>{}</p></article></div></body>',
    '<body><article class="post tags-news"><p>{}</p></article></body>',
    '<body><article class="tags-news"><p>{}</p></article></body>',
    '<body><form action="/"><div><article><p>{}</p></article></div></form></body>',
    '<body><form action="/"><p>{}</p></form><p>short</p></body>',
    '<body><main class="has-banner"><p>{}</p></main></body>',
    '<body><div class="menu-open"><div role="main" id="search-page"><p>{}</p></div></div></body>',
])
def test_article_in_named_wrapper(page):
    assert BODY in main_text(page.format(BODY))


def test_named_parts_beside_an_article_stay_out():
    page = f'<body><div class="wrap cookie-ok"><div class="sidebar"><p>{SIDE}</p></div><article><p>{BODY}</p></article><section class="related"><article class="related-item"><p>{SIDE}</p></article></section></div></body>'
    assert main_text(page) == BODY
    page = f'<body><article><p>{BODY}</p><p>{BODY}</p></article><div class="related"><article><p>{SIDE}</p></article></div><form><p>{SIDE}</p></form></body>'
    assert main_text(page) == f"{BODY} {BODY}"
    assert main_text(f'<body><div class="wide" hidden><main><p>{BODY}</p></main></div></body>') == ""


@pytest.mark.parametrize("wrap", ['<div class="layout sidebar-right">{}</div>', '<div class="page with-header">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="popup-free">{}</div>'])
@pytest.mark.parametrize("region", ["<article>{}</article>", "<main>{}</main>", '<article class="related-post">{}</article>', '<main id="legal-history">{}</main>'])
def test_wrappers_and_names_do_not_empty_a_page(wrap, region):
    text = f"<p>{BODY}</p><p>{BODY}</p>"
    assert main_text(f"<body><nav><a>Home</a></nav>{wrap.format(region.format(text))}<footer>made in 2020</footer></body>") == f"{BODY} {BODY}"


def test_pages_without_article_or_main():
    long = " ".join([BODY, BODY])
    page = f'<body><div id="top"><a href="/">Home</a> <a href="/x">News of the day</a></div><div><h1>The storm</h1><p>{long}</p><p>It was over.</p><p>{long}</p></div><div><a href="/a">{SIDE}</a></div><p>x</p></body>'
    got = main_text(page)
    assert got.count(BODY) == 4 and "It was over." in got and "The storm" in got and SIDE not in got and "Home" not in got


def test_boilerplate_inside_an_article():
    page = f'<article><div class="share"><p>{SIDE}</p></div><p>{BODY}</p><ul><li><a href="/">{SIDE}</a></li></ul><aside><p>{SIDE}</p></aside><p>{BODY}</p><section id="comments"><p>{SIDE}</p></section></article>'
    assert main_text(page) == f"{BODY} {BODY}"


def test_deep_pages_take_linear_time():
    from time import process_time

    began = process_time()
    n = 100_000
    assert main_text("<div>" * n + f"<p>{BODY}</p>" + "</div>" * n) == BODY
    main_text('<div class="ad"><p>x' * n)
    main_text("<p>short</p>" * n)
    main_text("<article>" * n + "</i>" * n)
    assert process_time() - began < 30


def test_pages_with_odd_rows(spark):
    from recallium.llm.html_text import extract_pages

    df = spark.createDataFrame([(None, None, None, "t", 1), (1, "u", "", "t", 2), (1, "u", f"<article><p>{BODY}</p></article>", "t", 3)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = extract_pages(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("None", "", 0), ("1", "", 0), ("1", BODY, len(BODY))] * 2)
    assert extract_pages(df).columns == ["page_id", "url", "text", "n_chars"] and extract_pages(df.limit(0)).count() == 0
