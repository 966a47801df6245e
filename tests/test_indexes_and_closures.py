"""Vector cells, the inverted index, closures of many roots and pooling against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.functions import scoring as S
from recallium.operators import closures as C
from recallium.operators import ranking as R
from recallium.operators import vector_index as V
from recallium.operators.text_index import TextIndex

POINT = "id long, vector array<float>, label int"


def points(n=600, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, 16))
    rows = [(k, (centres[k % 20] + r.normal(size=16) * 0.3).astype(np.float32).tolist(), k % 4) for k in range(n)]
    return rows + [(n + k, rows[0][1], 1) for k in range(300)] + [(2000, [0.0] * 16, 1), (2001, [0.0] * 16, 1)]


def brute(rows, k, asked, keep=lambda r: True):
    out = {}
    unit = {i: V.unit(np.array([v], np.float64))[0] for i, v, _ in rows}
    for q in asked:
        score = [(-round(float(unit[q] @ unit[i]), 12) + 0.0, i) for i, _, lab in rows if i != q and keep(lab)]
        out[q] = [i for _, i in sorted(score)[:k]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_exact_search_by_blocks(spark, monkeypatch):
    rows = points()
    df = spark.createDataFrame(rows, POINT)
    monkeypatch.setattr(V, "PART_ROWS", 150)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 10)
    asked = [i for i, *_ in rows if i % 20 == 0]
    assert by_query(V.exact_nearest(df, df.filter("id % 20 = 0").selectExpr("id as query_id", "vector as q"), 7)) == brute(rows, 7, asked)
    few = df.filter("id < 3")
    assert by_query(V.exact_nearest(few, few.selectExpr("id as query_id", "vector as q"), 10)) == brute(rows[:3], 10, [0, 1, 2])


def test_cells_find_at_least_nine_tenths(spark, tmp_path, monkeypatch):
    rows = points()
    df = spark.createDataFrame(rows, POINT)
    monkeypatch.setattr(V, "PART_ROWS", 150)
    index = V.VectorIndex(spark, f"{tmp_path}/i").build(df, "id", "vector", cells=24)
    assert index.rows().count() == len(rows)  # every row is in a cell
    q = df.filter("id % 20 = 0")
    truth = V.exact_nearest(df, q.selectExpr("id as query_id", "vector as q"), 10)
    measured = V.recall_against(index.search(q, 10, probes=6), truth).first()
    assert measured.recall >= 0.9 and measured.queries == q.count()
    assert by_query(index.search(q, 10, probes=None)) == by_query(truth)  # the exact way
    filtered = by_query(index.search(q, 5, probes=24, where=F.col("label") == 3))
    assert filtered == brute(rows, 5, [i for i, *_ in rows if i % 20 == 0], lambda lab: lab == 3)
    with pytest.raises(ValueError):
        V.VectorIndex(spark, f"{tmp_path}/j").build(df.withColumn("vector", F.when(F.col("id") > 5, F.col("vector"))), "id", "vector")


def test_index_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], POINT)
    index = V.VectorIndex(spark, f"{tmp_path}/i").build(df, "id", "vector")
    assert index.search(df, 5).count() == 0


def test_inverted_index_of_an_empty_table(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/x").build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert index.search(spark.createDataFrame([(1, "a b")], "query_id long, text string"), 5).count() == 0


@pytest.mark.parametrize("group_docs", [8, 4096])
def test_inverted_index_equals_the_scan(spark, tmp_path, group_docs):
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "é1", "the", "of", "rare"]
    docs = [(k, " ".join(r.choices(words, [5, 3, 2, 1, 30, 20, 0.1], k=r.randint(0, 60)))) for k in range(300)] + [(300, None), (301, ""), (302, "rare rare rare"), (303, "the " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "rare alpha"), (2, "the of"), (3, "Beta gamma é1 the beta"), (4, "nothing known"), (5, "")], "query_id long, text string")
    index = TextIndex(spark, f"{tmp_path}/x").build(df, "doc_id", "text", group_docs=group_docs)
    for k in (1, 5, 50):
        got = sorted(map(tuple, index.search(asked, k).select("query_id", "rank", "id", "score").collect()))
        want = sorted(map(tuple, R.bm25_search(df, asked, "doc_id", "text", k).select("query_id", "rank", "id", "score").collect()))
        assert got == want


def test_search_reads_only_its_terms_folders(spark, tmp_path):
    df = spark.createDataFrame([(k, f"w{k} common") for k in range(200)], "doc_id long, text string")
    index = TextIndex(spark, f"{tmp_path}/x").build(df, "doc_id", "text", buckets=16)
    plan = spark.read.parquet(f"{tmp_path}/x/blocks").filter(F.col("bucket").isin(3) & F.col("term").isin("w7"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and "EqualTo(term,w7)" in plan
    assert [r.id for r in index.search(spark.createDataFrame([(1, "w7")], "query_id long, text string"), 3).collect()] == [7]


def test_groups_below_the_threshold_are_left_out(spark, tmp_path):
    """A document that scores far above all others: the other groups' bounds do not reach it, and are not read."""
    from recallium.operators import text_index as T

    docs = [(k, "common filler words here " * 50 + "target") for k in range(400)] + [(999, "target target target")] + [(5000 + k, "other text") for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = TextIndex(spark, f"{tmp_path}/x").build(df, "doc_id", "text", group_docs=64)
    seen = []
    real = T._scored

    def spy(blocks, weights, groups):
        if groups is not None:
            seen.append(groups.count())
        return real(blocks, weights, groups)

    T._scored = spy
    try:
        got = index.search(spark.createDataFrame([(1, "target")], "query_id long, text string"), 1).collect()
    finally:
        T._scored = real
    assert [r.id for r in got] == [999] and seen == [4, 0]


# Closures


def brute_closures(mem, roots):
    kids = {}
    for u, i, p in mem:
        kids.setdefault((u, p), []).append(i)
    out = set()
    for root, u in roots:
        if not any((x, i) == (u, root) for x, i, _ in mem):
            continue
        seen, front, depth = {root}, [root], 0
        while front:
            depth += 1
            front = [c for f in front for c in kids.get((u, f), []) if c not in seen and not seen.add(c)]
            out |= {(root, u, c, depth) for c in front}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closures_with_cycles_and_foreign_parents(spark, seed):
    r = random.Random(seed)
    mem = [(r.choice("ab"), k, r.choice([None, k, r.randrange(80), r.randrange(max(1, k)), 900])) for k in range(80)]
    mem += [("c", 200 + k, 200 + k + 1) for k in range(70)] + [("d", 300, 301), ("d", 301, 302), ("d", 302, 300), ("d", 303, 302)]
    roots = [(k, r.choice("ab")) for k in range(0, 80, 3)] + [(270, "c"), (235, "c"), (200, "c"), (300, "d"), (302, "d"), (12345, "a"), (300, "d")]
    df = spark.createDataFrame(mem, "user_id string, id long, parent_id long")
    got = C.closures(df, spark.createDataFrame(roots, "root long, user_id string"))
    assert {tuple(x) for x in got.select("root", "user_id", "id", "depth").collect()} == brute_closures(mem, set(roots))


def test_erase_many_refuses_root_by_root(spark):
    mem = [("u", k, None if k == 0 else (k - 1) // 2, [61] if k == 3 else [1] if k == 61 else []) for k in range(62)] + [("w", 100, 1, [1])]
    df = spark.createDataFrame(mem, "user_id string, id long, parent_id long, derived_from array<long>")
    roots = spark.createDataFrame([(1, "u"), (30, "u"), (3, "u"), (5, "w"), (77, "u")], "root long, user_id string")
    plan, receipts = C.erase_many(df, roots, most=14)
    got = {r.root: (r.status, r.closure, r.depth, r.derived) for r in receipts.collect()}
    assert got == {1: ("refused", 30, 4, 0), 30: ("planned", 1, 1, 1), 3: ("planned", 14, 3, 0), 5: ("not_found_or_foreign", 0, 0, 0), 77: ("not_found_or_foreign", 0, 0, 0)}
    assert {r.root for r in plan.collect()} == {30, 3}
    left = C.apply_erase(df, plan)
    assert {(r.root, r.rows, r.children) for r in C.erase_residuals(left, plan).collect()} == {(30, 0, 0), (3, 0, 0)}
    assert any(r.rows for r in C.erase_residuals(df, plan).collect())


# Pooling


def test_pooling_equals_numpy(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(40):
        t, m = r.normal(size=(6, 5)), (np.arange(6) < k % 7).astype(int)
        rows.append((k, t.tolist(), m.tolist()))
    df = spark.createDataFrame(rows, "id long, tok array<array<double>>, mask array<int>")
    for x in df.select("id", S.cls_pool(F.col("tok")).alias("c"), S.mean_pool(F.col("tok"), F.col("mask")).alias("m")).collect():
        t, m = np.array(rows[x.id][1]), np.array(rows[x.id][2])
        mean = (t * m[:, None]).sum(0) / max(m.sum(), 1)
        assert np.allclose(x.c, t[0] / np.linalg.norm(t[0])) and np.allclose(x.m, mean / max(np.linalg.norm(mean), 1e-12))
