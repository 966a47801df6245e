"""Pinned examples of scores, states, slots, labels, filters."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recallium.functions import filters as L
from recallium.functions import scoring as S
from recallium.functions import text as T
from recallium.operators import ranking as R
from recallium.operators.analytics import trace_quality
from recallium.operators.lifecycle import check_contract

NOW = datetime(2026, 1, 1)


def one(spark, c, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(c).first()[0]


@pytest.mark.parametrize("days,decay", [(1, math.exp(-1 / 30)), (1100, 0.1)])
def test_time_decay(spark, days, decay):
    at = F.lit(NOW - timedelta(days=days)).cast("timestamp_ntz")
    got = one(spark, S.time_decay(F.lit(0.8), at, F.lit(0.5), F.lit(False), F.lit(NOW).cast("timestamp_ntz")))
    assert got == pytest.approx(0.8 * decay)


@pytest.mark.parametrize("s,want", [(0.5, 0.55), (0.0, 0.1), (1.5, 1.0), (-1.0, 0.1)])
def test_salience(spark, s, want):
    assert one(spark, S.next_salience(F.lit(s))) == pytest.approx(want)


def test_entity_boost(spark):
    asked = F.array(F.lit("A"), F.lit("b"))
    assert one(spark, S.entity_boost(F.lit(1.0), F.array(F.lit("a"), F.lit("B"), F.lit("c")), asked)) == pytest.approx(1.6)
    assert one(spark, S.entity_boost(F.lit(1.0), F.lit(None).cast("array<string>"), asked)) == 1.0


@pytest.mark.parametrize("row,want", [((None, True, True), "dirty"), (("x", True, None), "superseded"), ((None, None, True), "needs-check"), ((None, None, None), "current"), ((None, False, None), "current")])
def test_state(spark, row, want):
    assert one(spark, L.state(), "superseded_by string, dirty boolean, needs_check boolean", row) == want


def test_presence_differs_on_a_false_marker(spark):
    assert one(spark, L.state_by_presence(), "superseded_by string, dirty boolean, needs_check boolean", (None, False, None)) == "dirty"


def test_slots(spark):
    assert one(spark, T.normalise_slot(F.lit("  Proj-X  DB "))) == "proj-x db"
    assert one(spark, T.slot_key(F.lit(""), F.lit("a"), F.lit("s"))) is None
    assert one(spark, T.slot_key(F.lit("S"), F.lit("a"), F.lit(" "))) == "s|a|default"


def test_pronouns(spark):
    assert one(spark, T.needs_rewrite(F.lit("no sqlite on prod db"))) is False
    assert one(spark, T.needs_rewrite(F.lit("nó chạy ở cổng nào"))) is True
    assert one(spark, T.needs_rewrite(F.lit("It runs"))) is False


def test_wilson(spark):
    for k, lo, hi in ((57, 0.472, 0.663), (49, 0.394, 0.587)):
        a, b = S.wilson(F.lit(k), F.lit(100))
        assert (one(spark, a), one(spark, b)) == (lo, hi)


@pytest.mark.parametrize("days,want", [(365, "1 year ago"), (180, "6 months ago"), (730, "2 years ago"), (10, "1 month ago")])
def test_age_label(spark, days, want):
    assert one(spark, R.age_label(F.lit(days))) == want


def test_quality_is_tolerant(spark):
    t = ['{"citation":{"required":true,"has_citation":true},"hallucination":{"grounded":true},"grounding":{"label":"a","score":0.9},"answer":{"latency_ms":400}}', '{"citation":{"source_count":2},"hallucination":{"grounded":false},"grounding":{"label":"b","score":0.3},"answer":{"latency_ms":600}}', '{"citation":"x","correction":[1]}', "[]", "not json", None]
    r = trace_quality(spark.createDataFrame([(x,) for x in t], "trace string")).first()
    assert (r.sample_size, r.citation_rate, r.citation_sample, r.grounded_rate) == (6, 0.5, 2, 0.5)
    assert r.avg_grounding_confidence == pytest.approx(0.6) and r.avg_answer_latency_ms == 500


def test_filter_errors():
    for where in ({"salience": 0.5}, {"tags": {"$gt": 1}}, {"captured_at": {"$gt": "2024-01-01T00:00:00"}}, {"nope": 1}, {"pinned": {"$x": 1}}, {"pinned": {"$eq": 1, "$ne": 2}}, {"user_id": 1}, {"source_type": {"$in": "a"}}):
        with pytest.raises(ValueError):
            L.build_filter("u", where)
    with pytest.raises(ValueError):
        L.chunk_scope("", "c")


def test_exclusion_keeps_absent(spark):
    df = spark.createDataFrame([("u", None), ("u", "a"), ("v", "b")], "user_id string, source_type string")
    assert df.filter(L.build_filter("u", {"source_type": {"$ne": "a"}})).count() == 1
    assert df.filter(L.build_filter("u", {"source_type": {"$nin": ["a", "b"]}})).first().source_type is None


def test_text_helpers(spark):
    assert one(spark, T.cap_content(F.lit("x" * 10_001))) == "x" * 9_980 + T.CUT_MARK
    assert one(spark, T.llm_json(F.lit('say ```json\n{"a": 1}\n``` ok'))) == '{"a": 1}'
    assert one(spark, T.coerce_bool(F.lit("Yes"), False)) is True
    assert one(spark, L.snippet(F.lit("a" * 159 + " b"))) == "a" * 159 + "…"
    assert one(spark, T.word_match(F.lit("It is 10:45."), F.lit("10:45"))) is True
    assert one(spark, T.source_hit(F.array(F.lit("A b")), F.array(F.lit("a  B c"), F.lit("z")))) == 0.5
    assert T.canonical_token({"b": 1, "a": 2}) == T.canonical_token({"a": 2, "b": 1})
    assert T.cache_key("ab", "c") != T.cache_key("a", "bc")


def test_contract():
    check_contract(None, {"dim": 3}, populated=False)
    with pytest.raises(ValueError):
        check_contract(None, {"dim": 3}, populated=True)
    with pytest.raises(ValueError):
        check_contract({"dim": 2, "metric": "cosine", "token": "a"}, {"dim": 3, "metric": "cosine", "token": "a"}, True)


def test_rrf_and_bm25(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank int")
    b = spark.createDataFrame([(2, 0)], "id long, rank int")
    got = {r.id: r.score for r in R.reciprocal_rank_fusion([a, b]).collect()}
    assert got[2] == pytest.approx(1 / 61 + 1 / 62, abs=1e-6) and got[1] == pytest.approx(1 / 61, abs=1e-6)
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma"), (3, ""), (4, None)], "doc_id long, text string")
    out = R.bm25_search(docs, spark.createDataFrame([(0, "alpha")], "query_id long, text string"), "doc_id", "text", 5).collect()
    assert [(r.id, r["rank"]) for r in out] == [(1, 0)]
    n, df, avgdl = 4, 1, (3 + 5) / 4  # words and pairs of neighbours
    idf = math.log(n - df + 0.5) - math.log(df + 0.5)
    assert out[0].score == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), abs=1e-6)
    assert R.vector_top_k(spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>"), [1.0, 0.0], 0).count() == 0


def test_tasks_grow_with_the_rows(spark, sf_dir):
    from recallium.operators import graph as G
    from recallium.plans.adapters import tasks_for

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert tasks_for(lines, 100) == -(-lines.count() // 100) and tasks_for(lines) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    ment = spark.createDataFrame([(k % 9, f"N{k % 5}", "t", k / 10) for k in range(60)], "id long, name string, type string, salience double")
    stored = ment.filter("id < 4").selectExpr("id", "lower(name) as key", "type", "0.2D as salience")
    done = spark.createDataFrame([(1,), (5,)], "id long")
    one, wide = (G.merge_links(stored, ment, done, parts=p) for p in (None, 37))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, wide.collect())) and wide.count() > 9


def test_bm25_counts_only_the_terms_asked_for(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d d"), (3, "x"), (4, None)], "doc_id long, text string")
    assert {(r.term, r.n) for r in R.bm25_frequencies(docs, "text", ["d", "c"]).collect()} == {("c", 2), ("d", 1), (None, 13)}


def test_costs_are_not_shuffled_by_model(spark, sf_dir):
    from recallium.plans.aggregate_queries import cost_per_call

    plan = cost_per_call(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
