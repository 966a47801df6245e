"""Clips, files, syncs, co-mentions and reports: what they give in full, and odd input."""

from __future__ import annotations

import io
import zipfile
from itertools import combinations

import pytest

from recallium.functions.text import cache_key, cache_key_of
from recallium.operators.graph import co_mentions
from recallium.sources import connectors as C
from recallium.sources.source_store import SourceStore
from pyspark.sql import functions as F


def test_only_the_first_article_counts():
    assert C.clip_page("<body><p>out</p><article><p>one</p></article><article><p>two</p></article></body>", "https://h/x")[1] == "one"
    assert C.clip_page("<main><p>a</p></main><main><p>b</p></main>", "u")[1] == "a"
    assert C.clip_page("<article><p>a</p><article><p>inner</p></article></article><article><p>b</p></article>", "u")[1] == "a\n\ninner"


def test_inline_pieces_titles_and_dates():
    title, text, date = C.clip_page(f"<title>{'t ' * 400}</title><meta name='date' content='2020-01-01'><meta property='og:published_time' content='2021-02-03T04:05:06Z'><p>foo<b>bar</b> baz</p>", "u")
    assert len(title) == 500 and text == "foo bar baz" and date == "2021-02-03T04:05:06Z"
    assert C.clip_page("<meta name='DC.date.issued' content='2019'><p>x</p>", None) == ("", "x", "2019")
    assert C.clip_page("<p>x</p>", "https://host/p")[0] == "host" and C.clip_page("", "no address")[0] == "no address"


def test_pages_without_text_are_errors_of_their_own(spark):
    df = C.web_clips(spark.createDataFrame([("u1", "<p>x</p>"), ("u2", "<script>1</script>"), ("u3", None)], "url string, html string"))
    assert sorted(r.url for r in C.pages_without_text(df).collect()) == ["u2", "u3"]


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}{"".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs)}</w:p>' for s, runs in paragraphs)
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("H2", "Heading 2"), ("H3", "Heading 3"), ("N", "Normal")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
    return out.getvalue()


def test_word_files(spark):
    data = docx([("H1", ["Title"]), (None, ["one ", "two"]), ("H2", ["Sub"]), (None, ["  "]), ("H3", ["Deep"]), ("N", ["&amp; é"])])
    want = "## Title\n\none two\n\n### Sub\n\n#### Deep\n\n& é"
    assert C.docx_markdown(data) == want and C.docx_markdown(b"no zip") is None and C.docx_markdown(None) is None
    mime = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    rows = [(1, mime, data), (2, "text/plain", "é".encode()), (3, None, "é".encode("latin-1")), (4, mime, b"broken"), (5, mime, None)]
    got = {r.id: r.text for r in C.document_text(spark.createDataFrame(rows, "id int, mime string, content binary")).collect()}
    assert got == {1: want, 2: "é", 3: "é", 4: None, 5: None}


def test_capped_files_say_so(spark):
    df = spark.createDataFrame([(b"x" * 10,), (b"x" * 11,)], "content binary")
    assert [r.t for r in df.select(C.capped_file_text(F.col("content"), 10).alias("t")).collect()] == ["x" * 10, "x" * 10 + C.FILE_MARK]


def test_cache_keys_as_columns(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("é", None)], "x string, y string")
    assert [r.k for r in df.select(cache_key_of(F.col("x"), F.col("y")).alias("k")).collect()] == [cache_key("a", "bc"), cache_key("ab", "c"), cache_key("é", "")]


ITEMS = "pos long, source_id string, item_ref string, title string, content string, summary string, url string, captured_at timestamp"


def item(pos, ref, title, content="c", summary=None):
    return (pos, "s", ref, title, content, summary, None, None)


def test_sync_merges_and_reports_each_item(spark, tmp_path):
    store = SourceStore(spark, str(tmp_path), 4)
    none = spark.createDataFrame([], "source_id string, item_ref string")
    act = lambda df: {r.pos: r.action for r in df.collect()}
    first = spark.createDataFrame([item(1, "a", "t"), item(2, "a", "t"), item(3, "a", "u"), item(4, "b", "t")], ITEMS)
    assert act(store.sync(first, none, 0)) == {1: "added", 2: "skipped", 3: "updated", 4: "added"}
    assert act(store.sync(first, none, 0)) == {1: "added", 2: "skipped", 3: "updated", 4: "added"}  # delivered again
    second = spark.createDataFrame([item(5, "a", "u"), item(6, "b", "t", summary="new"), item(7, "c", "t"), item(8, "d", "t")], ITEMS)
    gone = spark.createDataFrame([("s", "d"), ("s", "d")], "source_id string, item_ref string")
    assert act(store.sync(second, gone, 1)) == {5: "skipped", 6: "updated", 7: "added", 8: "skipped"}
    assert {(r.item_ref, r.title, r.summary, r.revision) for r in store.read().collect()} == {("a", "u", None, 2), ("b", "t", "new", 2), ("c", "t", None, 1)}
    with pytest.raises(ValueError):
        store.sync(first, none, 0)
    with pytest.raises(ValueError):
        store.sync(spark.createDataFrame([item(9, None, "t")], ITEMS), none, 2)


def test_sync_broken_off_before_the_swap_decides_again(spark, tmp_path, monkeypatch):
    store = SourceStore(spark, str(tmp_path), 4)
    none = spark.createDataFrame([], "source_id string, item_ref string")
    rows = spark.createDataFrame([item(1, "a", "t")], ITEMS)
    real = store.store._commit
    monkeypatch.setattr(store.store, "_commit", lambda new: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.sync(rows, none, 0)
    monkeypatch.setattr(store.store, "_commit", real)
    assert [r.action for r in store.sync(rows, none, 0).collect()] == ["added"] and store.read().first().revision == 1


def test_co_mentions_against_brute_force(spark):
    rows = [(1, f"N{k}", 0.9 - k / 20, k + 1) for k in range(10)] + [(2, "A", 0.5, 1), (2, "a", 0.5, 2), (2, "B", 0.1, 3), (3, "alone", 0.5, 1)]
    got = {(r.id, r.source, r.target): r.weight for r in co_mentions(spark.createDataFrame(rows, "id long, name string, salience double, rank int")).collect()}
    want = {}
    for i in (1, 2, 3):
        first = sorted((r for r in rows if r[0] == i), key=lambda r: r[3])[:8]
        pairs = {}
        for a, b in combinations(first, 2):
            if a[1].lower() != b[1].lower():
                w = round(min(0.8, 0.35 + (a[2] + b[2]) / 4), 6)
                old = pairs.get((a[1].lower(), b[1].lower()))
                if old is None or w > old[2]:
                    pairs[a[1].lower(), b[1].lower()] = (a[1], b[1], w)
        best = sorted(enumerate(pairs.values()), key=lambda x: (-x[1][2], x[0]))[:24]
        want |= {(i, s, t): w for _, (s, t, w) in best}
    assert got == want and len([k for k in got if k[0] == 1]) == 24


def test_report_summary_of_no_cases(spark):
    cases = spark.createDataFrame([], "id long, category string, passed boolean, source_hit double, keyword_coverage double, has_citation boolean, fallback_accuracy double, hallucination boolean, corrected boolean, latency_ms double, sources array<string>")
    lines = [r.line for r in C.evaluation_report(cases, "now").orderBy("part", "id").collect()]
    assert lines[0] == "# Evaluation Report" and "| Total cases | 0 |" in lines and "| Average latency | 0.0 ms |" in lines
