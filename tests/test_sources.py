"""Importers, connectors, chunks, extraction, streams."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from recallium.operators import chunking as K
from recallium.operators import graph as G
from recallium.sources import connectors as C
from recallium.sources import importers as I
from recallium.streaming import streams as S

NOW = "TIMESTAMP'2024-01-30 00:00:00'"


def parse(spark, fmt, data):
    return I.parse_export(spark.createDataFrame([(json.dumps(data),)], "value string"), fmt, F.expr(NOW)).orderBy("pos").collect()


def test_chatgpt_order_and_roles(spark):
    node = lambda role, ts, *parts: {"message": {"author": {"role": role}, "create_time": ts, "content": {"parts": list(parts)}}}
    conv = {"id": "c1", "title": " T ", "create_time": 1700000000, "mapping": {"a": node("assistant", 2, "two", None), "b": node("user", 1, "one"), "c": node("system", 0, "no"), "d": {"message": None}, "e": node("user", None, " first ")}}
    r = parse(spark, "chatgpt", [conv, "junk", {"id": "empty", "mapping": {}}])
    assert len(r) == 1 and r[0].content == "User: first\n\nUser: one\n\nAssistant: two" and r[0].title == "T" and r[0].source_ref == "c1"


def test_other_formats(spark):
    r = parse(spark, "claude", [{"uuid": "u", "name": "", "chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "tool", "text": "x"}, {"sender": "assistant", "text": " yo "}]}])
    assert r[0].content == "User: hi\n\nAssistant: yo" and r[0].title == "Untitled Claude conversation"
    r = parse(spark, "openclaw", {"session_id": "abcdefghij", "entries": ["plain", {"role": "agent", "text": "x"}]})
    assert r[0].content == "User: plain\n\nAssistant: x" and r[0].title == "OpenClaw session abcdefgh"
    r = parse(spark, "generic", [{"content": " c ", "tags": "abc"}, {"content": ""}, 5, {"content": "d", "tags": ["a", " ", "b"], "created_at": 1700000000}])
    assert [(x.content, x.tags) for x in r] == [("c", []), ("d", ["a", "b"])]
    r = parse(spark, "pam", {"schema": "portable-ai-memory", "memories": [{"content": "z" * 200, "type": "fact", "provenance": "text"}]})
    assert r[0].title == "[fact] " + "z" * 120 and r[0].tags == ["fact"]
    r = parse(spark, "gemini", [{"text": "only text"}])
    assert r[0].content == "only text"
    with pytest.raises(I.ImportFormatError):
        parse(spark, "nope", [])
    with pytest.raises(Exception, match="not a claude export"):
        parse(spark, "claude", {"a": 1})


@pytest.mark.parametrize("data,want", [([{"mapping": {}}], "chatgpt"), ([{"chat_messages": []}], "claude"), ([{"content": "x"}], "generic"), ({"schema": "portable-ai-memory"}, "generic"), ({"session_id": "s", "entries": []}, "openclaw"), ({"memories": [], "export_version": 1}, "gemini"), ({"memory_entries": []}, "openclaw"), ({"conversations": [], "copilot_version": 1}, "copilot"), ([], "unknown"), ({"x": 1}, "unknown")])
def test_detect(spark, data, want):
    assert spark.createDataFrame([(json.dumps(data),)], "v string").select(I.detect_format(F.col("v"))).first()[0] == want


def test_pages_mail_blocks():
    title, text, date = C.clip_page("<html><head><title>T</title><meta property='article:published_time' content='2024-01-01'></head><body><nav><p>menu</p></nav><article><h1>H</h1><p>a &amp; b</p></article><p>out</p></body></html>", "https://h/x")
    assert (title, text, date) == ("T", "H\n\na & b", "2024-01-01")
    assert C.clip_page("", "https://host.example/x")[0] == "host.example"
    assert C.mail_text({"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": "PGI-aGk8L2I-"}}, {"mimeType": "text/plain", "body": {"data": "aGVsbG8"}}]}) == "hello"
    assert C.block_markdown({"type": "to_do", "to_do": {"checked": True, "rich_text": [{"plain_text": "x"}]}, "_subchildren": [{"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "y"}]}}]}) == "[x] x\n  y\n"


def test_mail_parts_and_blocks_in_full():
    text = lambda t: {"mimeType": "text/plain", "body": {"data": t}}
    assert C.mail_text({"mimeType": "multipart/mixed", "parts": [text("aGVsbG8"), text("d29ybGQ"), text("!!!!a")]}).startswith("hello\nworld")
    assert C.mail_text(text("aGVsbG8")) == "hello" and C.mail_text(None) == ""
    rich = lambda t: [{"plain_text": t}]
    for block, want in [
        ({"type": "callout", "callout": {"rich_text": rich("c")}}, "💡 c\n"), ({"type": "callout", "callout": {"icon": {"emoji": "🔥"}, "rich_text": rich("c")}}, "🔥 c\n"),
        ({"type": "code", "code": {"language": "py", "rich_text": rich("x=1")}}, "```py\nx=1\n```\n"), ({"type": "divider", "divider": {}}, "---\n"),
        ({"type": "bookmark", "bookmark": {"url": "u"}}, "🔖 [u](u)\n"), ({"type": "embed", "embed": {"url": "u"}}, "🔗 <u>\n"), ({"type": "equation", "equation": {"expression": "e"}}, "📐 e\n"),
        ({"type": "file", "file": {"file": {"url": "u"}}}, "📎 u\n"), ({"type": "child_page", "child_page": {"title": "t"}}, "📄 **t**\n"), ({"type": "new_kind"}, "<!-- unsupported block: new_kind -->\n"), ({}, "\n"),
    ]:
        assert C.block_markdown(block) == want


def test_session_logs(spark):
    logs = ["**User:** hi there\nmore\n\n**Assistant**: yo\n## User manual\nx", "just text\n", "## Human\n", "**AI:** **bold** start", "   ", None, "before\n## Agent: said\r\nnext"]
    df = spark.createDataFrame(list(enumerate(logs)), "k long, t string")
    got = sorted((r.k, r.turn, r.role, r.text) for r in C.session_turns(df, "k", "t").collect())
    assert got == [(0, 1, "user", "hi there\nmore"), (0, 2, "assistant", "yo\n## User manual\nx"), (1, 1, "user", "just text"), (2, 1, "user", "## Human"), (3, 1, "assistant", "bold** start"), (6, 1, "assistant", "said\nnext")]


def test_headings():
    s = K.sections("# Title\nintro\n## A\na\n### B\nb\n## C\nc")
    assert [x[:4] for x in s] == ["## A", "### ", "## C"]
    assert K.parents("# Title\nintro only") == ["# Title\nintro only"]


def test_chunk_invariants():
    text = " ".join(f"Sentence number {k} has some words." for k in range(400)) + "\n\n" + "x" * 5000
    for p in K.parents(text):
        assert len(p) <= K.PARENT
        for c in K.split_recursive(p, K.CHILD, K.CHILD_OVERLAP):
            assert len(c) <= K.CHILD and c in p
    assert all(f"number {k} " in " ".join(K.parents(text)) for k in range(400))


def test_turn_packs(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * n) for t, n in enumerate([50, 60, 300, 10, 20])]
    got = K.pack_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 150).orderBy("pack").collect()
    assert [r.turns for r in got] == [[0, 1], [1, 2], [2, 3], [3, 4]]  # the turn before always comes along


def test_extraction_matches_python(spark):
    from recallium.functions.text import DATE_PATTERN, PHRASE_PATTERN

    texts = ["Project Atlas met Élodie Durand on 2024-05-06 in NEW YORK 12 today", "the And For Dr Who 3-4-2021", "Łódź Über alles", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, content string")
    got = {}
    for r in G.extract_entities(df, "id", "content", most=1000).collect():
        got.setdefault(r.id, set()).add((r.name, r.type))
    for k, t in enumerate(texts):
        want = {(m, "date") for m in re.findall(DATE_PATTERN, t)}
        best = {}
        for m in re.findall(PHRASE_PATTERN, t):
            n = " ".join(m.split())
            if len(n) >= 3 and n.lower() not in {"the", "and", "for"}:
                best.setdefault((n.lower(), "project" if n.lower().startswith("project ") else "other"), n)
        want |= {(n, kind) for (_, kind), n in best.items()}
        assert got.get(k, set()) == want


def test_components_long_path(spark):
    nodes = spark.range(60).selectExpr("id as node", "cast(id as string) as name", "1 as mention_count")
    edges = spark.range(39).selectExpr("id as source", "id + 1 as target", "1.0D as weight")
    got = {r.node: r.comp for r in G.components(nodes, edges).collect()}
    assert all(got[k] == 0 for k in range(40)) and all(got[k] == k for k in range(40, 60))


def test_descendants_stop_at_cycles(spark):
    m = spark.createDataFrame([(1, 3, 7), (2, 1, 7), (3, 2, 7), (4, 3, 8)], "id long, parent_id long, user_id int")
    below, depth, refused = G.descendants(m, 1, 7)
    assert {r.id for r in below.collect()} == {2, 3} and not refused
    assert G.descendants(m, 1, 7, most=1)[2]


def test_stream_distinct_and_windows(spark, tmp_path, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), src.schema)
    q = S.distinct_within(stream, ["user_id", "event_type"], "60 days").writeStream.format("memory").queryName("distinct_once").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("distinct_once").count() == src.select("user_id", "event_type").distinct().count()


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("## User\nhi\n## Agent\nyo")
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    f = C.read_files(spark, str(tmp_path))
    assert {r.text for r in f.collect()} == {"## User\nhi\n## Agent\nyo", "café"}
    assert C.changed_files(f, f).count() == 0
    turns = C.session_turns(f.filter("path like '%.md'"), "path", "text").orderBy("turn").collect()
    assert [(r.role, r.text) for r in turns] == [("user", "hi"), ("assistant", "yo")]
