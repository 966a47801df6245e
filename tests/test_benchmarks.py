from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recallium.sources import benchmarks as B

GOOD = {"question_id": "q1", "question_type": "t", "question": "when?", "answer": "2024-01-02", "question_date": "2026/07/05 (Sun) 02:21", "haystack_session_ids": ["a", "b"], "haystack_dates": ["2023/05/20 (Sat) 02:21", "2026-07_05"], "haystack_sessions": [[{"role": "user", "content": "x", "has_answer": True}], [{"role": "user", "content": "y"}, {"role": "assistant", "content": "z"}]], "answer_session_ids": ["a"]}


def test_history(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([GOOD]))
    q = B.load_history(spark, str(tmp_path / "g.json"))
    turns = B.history_turns(q).orderBy("session", "turn").collect()
    assert [(t.session_id, t.content) for t in turns] == [("a", "x"), ("b", "y"), ("b", "z")]
    assert turns[0]["at"].year == 2023 and turns[1]["at"] is None
    for change in ({"haystack_dates": ["x"]}, {"answer_session_ids": ["zz"]}, {"question": ""}):
        (tmp_path / "b.json").write_text(json.dumps([GOOD | change]))
        with pytest.raises(Exception, match="q1"):
            B.load_history(spark, str(tmp_path / "b.json")).collect()


def test_answer_kinds_rerank_and_counters(spark):
    kinds = {"Yes": "boolean", "-12": "integer", " 3.5 ": "float", "1e3": "float", "nan": "float", "$1,200": "text", "on 2024-01-02": "text", "a cat": "text", None: "text"}
    df = spark.createDataFrame([(k,) for k in kinds], "a string")
    assert {r.a: r.k for r in df.select("a", B.answer_kind(F.col("a")).alias("k")).collect()} == kinds
    c = spark.createDataFrame([(1, "aa"), (2, "a"), (3, None), (4, "bb")], "id long, content string")
    assert [r.id for r in B.rerank(c, "q", lambda q, t: [float(len(x)) for x in t], 3).collect()] == [1, 4, 2]
    old = spark.createDataFrame([("view", 2, 5)], "f string, n long, last_used long")
    new = spark.createDataFrame([("view", 9), ("view", 3), ("click", 1)], "f string, ts long")
    assert {(r.f, r.n, r.last_used) for r in B.usage_upsert(old, new, ["f"]).collect()} == {("view", 4, 9), ("click", 1, 1)}
