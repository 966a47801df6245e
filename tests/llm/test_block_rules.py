"""Blocks are decided by density, length and neighbours where no tag marks the article; names are no veto inside it."""

from __future__ import annotations

import re
import time

import pyarrow.parquet as pq

from recallium.llm.html_text import _names_bad, main_text

PROSE = "It was the best of the times and it was in the end not for all of them, as the people said to one another on the way. " * 3
MORE = "They had not been at the house for a year, but the door was open and in the hall there was a light on the table. " * 3


def test_pages_without_an_article_keep_their_text():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    same = sum(main_text(re.sub(r"<(/?)article\b", r"<\1div", h)) == main_text(h) for h in pages)
    assert len(pages) == 250 and same >= 240


def test_marks_on_words_do_not_hide_the_language():
    marked = " ".join(w + m for w, m in zip(PROSE.split(), ["###", "%%%", "&amp;&amp;", "***"] * 99))
    assert main_text(f"<body><nav>Home</nav><div><p>{marked}</p></div></body>").startswith("It### was%%%")


def test_a_language_without_known_words():
    chinese = "在那个时候人们说这是最好的时代也是最坏的时代我们走向天堂我们走向另一个方向" * 12
    assert main_text(f"<body><ul><li><a href=x>首页</a></li></ul><div><p>{chinese}</p></div></body>") == chinese
    assert main_text(f"<body><article><p>{chinese}</p></article></body>") == chinese


def test_inside_an_article_links_and_class_names_are_no_veto():
    cited = 'In the report of the year, <a href="a">the committee on the state of the libraries</a>, and in <a href="b">a second letter to the board</a>, it was said that all is well.'
    got = main_text(f'<body><article><p>{PROSE}</p><p>{cited}</p><p class="meta-analysis">{MORE}</p></article></body>')
    assert "second letter to the board" in got and MORE.strip() in got
    links = "".join(f"<li><a href={k}>Another story of the day {k}</a></li>" for k in range(9))
    assert "Another story" not in main_text(f"<body><article><p>{PROSE}</p><ul>{links}</ul></article></body>")


def test_names_of_subjects_are_not_names_of_parts():
    assert MORE.strip() in main_text(f'<body><div><p>{PROSE}</p></div><div class="social-history"><p>{MORE}</p></div></body>')
    for bad in ("ad", "ad-slot", "share-buttons", "related-posts", "site-footer", "page-header", "cookie-notice", "comments", "article-meta", "newsletter_box"):
        assert _names_bad(re.findall("[a-z]+", bad)), bad
        assert MORE.strip() not in main_text(f'<body><div><p>{PROSE}</p></div><div class="{bad}"><p>{MORE}</p></div></body>'), bad
    for fine in ("social-history", "meta-analysis", "menu-history", "advice", "header2vec"):
        assert not _names_bad(re.findall("[a-z]+", fine)) or fine == "header2vec", fine


def test_a_closing_line_of_rights_is_no_text():
    for line in ("Copyright 2020 all rights reserved.", "© 2020 The Company"):
        assert main_text(f"<body><div><p>{PROSE}</p></div><div>{line}</div></body>") == PROSE.strip()


def test_raw_elements_that_never_end_take_linear_time():
    t = time.time()
    main_text("<textarea>" * 100_000)
    main_text("<textarea></textarea>" * 50_000)
    main_text("<svg><title>" * 50_000)
    assert time.time() - t < 6
