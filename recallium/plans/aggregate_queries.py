"""Usage, cost, quality, experiments and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallium.operators import analytics as A
from recallium.plans.adapters import GRAPH, MEM, graph, memories, table
from recallium.plans.catalog import query


@query("SELECT source AS source_type, count(*) AS n FROM documents GROUP BY 1")
def stats_by_source(spark, d):
    return A.source_stats(memories(spark, d))


@query(f"WITH {MEM} SELECT count(*) FILTER (captured_at >= TIMESTAMP '2024-01-23') AS last_week, count(*) AS total FROM mem")
def recent_count(spark, d):
    return memories(spark, d).agg(F.count_if(F.expr("captured_at >= TIMESTAMP_NTZ'2024-01-23 00:00:00'")).alias("last_week"), F.count(F.lit(1)).alias("total"))


@query(f"WITH {MEM}, t AS (SELECT unnest(tags) AS tag FROM mem) SELECT tag, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark, d):
    return A.top_tags(memories(spark, d))


@query("SELECT event_type, count(*) AS n, max(ts) AS last_used FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1")
def feature_usage(spark, d):
    return A.feature_usage(table(spark, d, "events"), F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'"), ["event_type"])


@query("SELECT props->>'$.k' AS path, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def page_views(spark, d):
    return table(spark, d, "events").filter("event_type = 'view'").transform(A.counts_by, F.get_json_object("props", "$.k"), "path")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def daily_active_users(spark, d):
    return A.daily_active(table(spark, d, "events")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT coalesce(nullif(trim(CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END), ''), 'unknown') AS name, date_trunc('millisecond', ts) AS ts, 'u' || user_id AS path, user_id FROM events")
def event_normalise(spark, d):
    raw = table(spark, d, "events").selectExpr("case when event_type = 'error' then ' ' else event_type end as name", "unix_millis(cast(ts as timestamp)) as ts_ms", "to_json(named_struct('url', concat('u', user_id))) as properties", "user_id")
    return A.normalise_events(raw)


_TRACE = "'{\"citation\":{\"required\":' || (event_id % 2 = 0) || ',\"has_citation\":' || (event_id % 3 = 0) || '},\"hallucination\":{\"grounded\":' || (event_id % 5 <> 0) || '},\"correction\":[' || CASE WHEN event_id % 7 = 0 THEN '1' ELSE '' END || '],\"grounding\":{\"label\":\"' || CASE WHEN event_id % 4 = 0 THEN 'not_applicable' ELSE 'ok' END || '\",\"score\":' || value || '},\"answer\":{\"latency_ms\":' || (event_id % 100) || '}}'"


@query("SELECT count(*) AS sample_size, round(count(*) FILTER (event_id % 6 = 0) / count(*) FILTER (event_id % 2 = 0), 4) AS citation_rate, count(*) FILTER (event_id % 2 = 0) AS citation_sample, round(count(*) FILTER (event_id % 5 <> 0) / count(*), 4) AS grounded_rate, count(*) AS grounded_sample, round(1 - round(count(*) FILTER (event_id % 5 <> 0) / count(*), 4), 4) AS hallucination_flag_rate, round(count(*) FILTER (event_id % 7 = 0) / count(*), 4) AS self_correction_rate, round(sum(value) FILTER (event_id % 4 <> 0) / count(*) FILTER (event_id % 4 <> 0), 4) AS avg_grounding_confidence, count(*) FILTER (event_id % 4 <> 0) AS grounding_confidence_sample, round(sum(event_id % 100) / count(*), 2) AS avg_answer_latency_ms, count(*) AS latency_sample FROM events")
def trace_quality(spark, d):
    t = table(spark, d, "events").selectExpr("""concat('{"citation":{"required":', event_id % 2 = 0, ',"has_citation":', event_id % 3 = 0, '},"hallucination":{"grounded":', event_id % 5 <> 0, '},"correction":[', if(event_id % 7 = 0, '1', ''), '],"grounding":{"label":"', if(event_id % 4 = 0, 'not_applicable', 'ok'), '","score":', value, '},"answer":{"latency_ms":', event_id % 100, '}}') as trace""")
    return A.trace_quality(t)


_PRICES = [("A", 3.0, 15.0), ("N", 0.25, 1.0)]
_COST = "round(coalesce(l_quantity / 1e6 * price_in + l_extendedprice / 1e6 * price_out, 0), 8)"
_CALLS = f"p(model, price_in, price_out) AS (VALUES ('A', 3.0::DOUBLE, 15.0::DOUBLE), ('N', 0.25::DOUBLE, 1.0::DOUBLE)), calls AS (SELECT l_orderkey, l_linenumber, l_suppkey AS agent, {_COST} AS cost FROM lineitem LEFT JOIN p ON model = l_returnflag)"


def _calls(spark, d):
    prices = spark.createDataFrame(_PRICES, "model string, price_in double, price_out double")
    calls = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey as agent", "l_returnflag as model", "l_quantity as tokens_in", "l_extendedprice as tokens_out")
    return A.call_costs(calls, prices, places=8)


@query(f"WITH {_CALLS} SELECT l_orderkey, l_linenumber, cost FROM calls")
def cost_per_call(spark, d):
    return _calls(spark, d).select("l_orderkey", "l_linenumber", "cost")


@query(f"WITH {_CALLS} SELECT agent, count(*) AS calls, round(sum(cost), 4) AS total FROM calls GROUP BY 1")
def cost_by_agent(spark, d):
    return A.cost_by_agent(_calls(spark, d)).withColumn("total", F.round("total", 4))


@query(f"WITH {_CALLS} SELECT round(sum(cost), 3) AS total, CASE WHEN sum(cost) / 1000 >= 1 THEN 'exceeded' WHEN sum(cost) / 1000 >= 0.8 THEN 'warning' ELSE 'ok' END AS level FROM calls")
def budget_alert(spark, d):
    return A.budget_alert(_calls(spark, d), 1000.0).select(F.round("total", 3).alias("total"), "level")


@query("WITH a AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant FROM events), u AS (SELECT variant, count(*) AS users FROM a GROUP BY 1) SELECT variant, event_type AS metric, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, users FROM events JOIN a USING (user_id) JOIN u USING (variant) GROUP BY ALL")
def experiment_results(spark, d):
    e = table(spark, d, "events")
    a = e.select("user_id", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("variant")).distinct()
    return A.experiment_results(a, e.selectExpr("user_id", "event_type as metric", "value")).withColumn("total", F.round("total", 4))


_RUNS = "m AS (SELECT o_orderstatus AS run, o_orderpriority AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2)"


def _runs(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@query(f"WITH {_RUNS} SELECT run, max(value) FILTER (metric = '1-URGENT') AS urgent, max(value) FILTER (metric = '2-HIGH') AS high, max(value) FILTER (metric = 'none') AS none FROM m GROUP BY 1")
def run_comparison(spark, d):
    return A.compare_runs(_runs(spark, d), ["1-URGENT", "2-HIGH", "none"]).select("run", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), "none")


@query(f"WITH {_RUNS} SELECT run, metric, value FROM m WHERE metric = '2-HIGH' ORDER BY value DESC, run LIMIT 1")
def best_run(spark, d):
    return A.best_run(_runs(spark, d), "2-HIGH")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 4 THEN 3 ELSE 1 END AS reward FROM orders")
def referral_tiers(spark, d):
    return A.referral_tiers(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "reward")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def referral_leaderboard(spark, d):
    return A.leaderboard(table(spark, d, "orders"), "o_custkey")


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events")
def platform_stats(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "signup").alias("signups"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))


_CASES = "c AS (SELECT lang, source, quality = 1 AS passed, quality * 0.6 + (1 - toxic) * 0.3 AS score FROM labels JOIN documents USING (doc_id))"


def _cases(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").selectExpr("lang", "source", "quality = 1 as passed", "quality * 0.6D + (1 - toxic) * 0.3D as score")


@query(f"WITH {_CASES}, g AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (passed)::DOUBLE AS k FROM c GROUP BY 1) SELECT lang, n::BIGINT AS n, k::BIGINT AS passes, round(k / n, 6) AS rate, round(greatest(0, (k/n + 1.96*1.96/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 3) AS low, round(least(1, (k/n + 1.96*1.96/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 3) AS high FROM g")
def eval_pass_rate(spark, d):
    return A.eval_summary(_cases(spark, d), ["lang"])


@query(f"WITH {_CASES} SELECT lang, source, count(*) AS n, round(avg(score), 6) AS mean, round(avg((score >= 0.7)::INT), 6) AS pass_rate FROM c GROUP BY GROUPING SETS ((), (lang), (source))")
def judge_summary(spark, d):
    return A.judge_summary(_cases(spark, d), ["lang", "source"])


@query("SELECT avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS mean, round(avg(toxic) FILTER (quality = 0), 6) AS toxic_of_bad, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def benchmark_mean(spark, d):
    m = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return m.agg(F.avg(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("double")).alias("mean"), F.round(F.avg(F.when(F.col("quality") == 0, F.col("toxic"))), 6).alias("toxic_of_bad"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, round(avg(weight), 6) AS mean_weight, round(2 * count(*) / (SELECT count(*) FROM nodes), 6) AS mean_degree, round(2 * count(*) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 9) AS density FROM edges")
def graph_metrics(spark, d):
    return A.graph_metrics(*graph(spark, d))


@query("SELECT event_type AS path, count(*) AS n FROM events WHERE event_type IN ('error') GROUP BY 1")
def fallback_counters(spark, d):
    return A.counts_by(table(spark, d, "events").filter("event_type = 'error'"), F.col("event_type"), "path")


@query("SELECT event_id, ts, count(*) OVER () AS total FROM events WHERE user_id = 5 AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 2")
def access_ledger(spark, d):
    e = table(spark, d, "events").filter("user_id = 5 and event_type = 'click'")
    return A.ledger_page(e, 2, 10).select("event_id", "ts", "total")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS granted FROM events")
def quota_replay(spark, d):
    return A.quota_replay(table(spark, d, "events"), 2).select("event_id", "granted")
