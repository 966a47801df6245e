"""The inverted index by runs: what it writes and shuffles, terms that several words give, repeated ids."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from recallium.operators import ranking as R
from recallium.operators import text_index as T

DOC = "doc_id long, text string"
WORDS = ["a", "b", "a_b", "_", "b_", "x", "the", "é1", "__c", "a_b_c", "c"]


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_postings_are_not_shuffled_and_take_little_space(spark, tmp_path):
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "ster") for b in ("la", "nu", "rep", "to") for c in range(100)]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=400))) for k in range(1000)], DOC).repartition(8).localCheckpoint()
    before = shuffled(spark)
    T.TextIndex(spark, f"{tmp_path}/x").build(docs, "doc_id", "text", group_docs=64)
    postings = 1000 * 730  # about as many terms a document
    assert shuffled(spark) - before < 6 * postings
    assert sum(p.stat().st_size for p in Path(tmp_path).rglob("*.parquet")) < 8 * postings


@pytest.mark.parametrize(("docs", "weight", "rows"), [(8192, 1 << 21, 1 << 15), (5, 1 << 21, 3), (50, 40, 7)])
def test_runs_hold_each_posting_once(monkeypatch, docs, weight, rows):
    for name, value in (("RUN_DOCS", docs), ("RUN_WEIGHT", weight), ("OUT_ROWS", rows)):
        monkeypatch.setattr(T, name, value)
    r = random.Random(1)
    for voc in (WORDS, ["p", "q", "rr"], []):
        texts = [r.choices(voc, k=r.randint(0, 40)) if voc else [] for _ in range(100)]
        b = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([" ".join(w) for w in texts])], ["id", "w"])
        got, seen = {}, []
        for ids, lists in T._runs(iter([b.slice(k, 7) for k in range(0, 100, 7)])):
            seen += ids.to_pylist()
            words, key, at, doc, tf = T._inverted(lists)
            of = np.repeat(np.arange(len(key)), np.diff(at, append=len(doc)))
            terms = T._named(words, key).to_pylist()
            assert len(set(terms)) == len(terms)
            got |= {(terms[t], ids[int(d)].as_py()): int(f) for t, d, f in zip(of, doc, tf, strict=True)}
        assert seen == list(range(100))
        assert got == {(t, i): n for i, w in enumerate(texts) for t, n in Counter(w + [f"{x}_{y}" for x, y in zip(w, w[1:])]).items()}


@pytest.mark.parametrize("repeated", [False, True])
def test_search_over_many_runs_equals_the_scan(spark, tmp_path, monkeypatch, repeated):
    r = random.Random(2)
    rows = [(k % 90 if repeated else k, " ".join(r.choices(WORDS, [9, 5, 1, 1, 1, 3, 30, 1, 1, 1, 2], k=r.randint(0, 40)))) for k in range(400)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    asked = spark.createDataFrame([(1, "a b"), (2, "the a_b_c"), (3, "the the __c x")], "query_id long, text string")
    index = T.TextIndex(spark, f"{tmp_path}/x").build(df, "doc_id", "text", group_docs=16)
    for k in (2, 30):
        got = sorted(map(tuple, index.search(asked, k).select("query_id", "rank", "id", "score").collect()))
        assert got == sorted(map(tuple, R.bm25_search(df, asked, "doc_id", "text", k).select("query_id", "rank", "id", "score").collect()))
