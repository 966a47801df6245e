"""Numbers of links of the Jaccard join against brute force, inside components too."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from test_pairs_and_groups import corpus, frame
from test_queries import rows

from recallium.llm import jaccard_join as J
from recallium.llm import queries as Q


def brute_links(texts, n, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    classes = {s for s in sets if s}
    links = {s: sum(t != s and den * len(s & t) >= num * len(s | t) for t in classes) for s in classes}
    return [links.get(s, 0) for s in sets]


@pytest.mark.parametrize("n,num,den,block", [(4, 85, 100, 512), (5, 80, 100, 2), (1, 50, 100, 3)])
def test_links_inside_components(spark, monkeypatch, n, num, den, block):
    monkeypatch.setattr(J, "LINK_SETS", block)
    words = [f"v{k}" for k in range(120)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(0, 120, 10)]  # all mutually similar
    texts = corpus() + near + near[:2]
    want = brute_links(texts, n, num, den)
    assert max(want) > 2
    got = {r.doc_id: r.n_links for r in J.jaccard_links(frame(spark, texts), n=n, num=num, den=den).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_links_of_repeated_and_null_ids(spark):
    words = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, words + " z"), (1, words), (1, words + " a"), (1, "quite another text"), (2, words + " b"), (2, words + " b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_links) for r in J.jaccard_links(df).collect()), key=str)
    assert got == sorted([(None, 0), (1, 2), (1, 2), (1, 0), (2, 2), (2, 2)], key=str)
    assert J.jaccard_links(df.limit(0)).count() == 0


def test_products_of_many_columns(monkeypatch):
    monkeypatch.setattr(J, "LINK_COLUMNS", 7)
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 2**63, 90).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(90) > 0.05], r.integers(0, 2**63, 3).astype(np.uint64)])) for _ in range(15)]
    pair = lambda s, t: 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))
    want = [sum(a != b and pair(s, t) for b, t in enumerate(sets)) for a, s in enumerate(sets)]
    assert J.links_within(sets, None, 85, 100).tolist() == want and 0 < sum(want) < 15 * 14
    first = np.arange(15) % 3 == 0
    want = [sum(first[a] != first[b] and pair(s, t) for b, t in enumerate(sets)) for a, s in enumerate(sets)]
    assert J.links_within(sets, first, 85, 100).tolist() == want


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op1_ngram_jaccard_links"])
def test_query_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got, want = Q.QUERIES[name](spark, sf_dir).toPandas(), c.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
