"""Aggregations: usage, cost, quality, experiments, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallium.functions.scoring import wilson


def rate(num: Column, den: Column, places: int = 4) -> Column:
    """A share of its own denominator; 0 where that is 0."""
    return F.when(den > 0, F.round(num / den, places)).otherwise(0.0)


def source_stats(memories: DataFrame) -> DataFrame:
    return memories.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


def top_tags(memories: DataFrame, n: int = 10) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("tag")).limit(n)


def normalise_events(raw: DataFrame) -> DataFrame:
    """Name (``unknown`` if there is none), UTC time of epoch milliseconds, path from the properties' url."""
    return raw.select(F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.lit("unknown")).alias("name"), F.timestamp_millis("ts_ms").cast("timestamp_ntz").alias("ts"), F.get_json_object("properties", "$.url").alias("path"), "user_id")


def feature_usage(events: DataFrame, since: Column, by: list[str], when: str = "ts") -> DataFrame:
    return events.filter(F.col(when) >= since).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("last_used"))


def daily_active(events: DataFrame, when: str = "ts", user: str = "user_id") -> DataFrame:
    return events.groupBy(F.to_date(when).alias("day")).agg(F.countDistinct(user).alias("users"))


def trace_quality(traces: DataFrame, col: str = "trace") -> DataFrame:
    """Quality rates over JSON traces, each with its own denominator; malformed parts count as absent."""
    j = lambda p: F.get_json_object(col, p)
    truthy = lambda c: F.coalesce(~F.lower(c).isin("false", "0", "", "null", "0.0"), F.lit(False))
    cited = truthy(j("$.citation.required")) | truthy(j("$.citation.source_count"))
    grounded = j("$.hallucination.grounded").isNotNull()
    sure = (F.coalesce(j("$.grounding.label"), F.lit("not_applicable")) != "not_applicable") & j("$.grounding.score").isNotNull()
    score, latency = j("$.grounding.score").try_cast("double"), j("$.answer.latency_ms").try_cast("double")
    s = traces.agg(
        F.count(F.lit(1)).alias("sample_size"), F.count_if(cited).alias("citation_sample"), F.count_if(cited & truthy(j("$.citation.has_citation"))).alias("_c"),
        F.count_if(grounded).alias("grounded_sample"), F.count_if(grounded & truthy(j("$.hallucination.grounded"))).alias("_g"),
        F.count_if(F.coalesce(F.json_array_length(j("$.correction")), F.lit(0)) > 0).alias("_r"), F.count_if(sure).alias("grounding_confidence_sample"),
        F.sum(F.when(sure, F.coalesce(score, F.lit(0.0)))).alias("_s"), F.count(latency).alias("latency_sample"), F.sum(latency).alias("_l"))
    g = rate(F.col("_g"), F.col("grounded_sample"))
    return s.select("sample_size", rate(F.col("_c"), F.col("citation_sample")).alias("citation_rate"), "citation_sample", g.alias("grounded_rate"), "grounded_sample",
                    F.when(F.col("grounded_sample") > 0, F.round(1.0 - g, 4)).otherwise(0.0).alias("hallucination_flag_rate"), rate(F.col("_r"), F.col("sample_size")).alias("self_correction_rate"),
                    rate(F.col("_s"), F.col("grounding_confidence_sample")).alias("avg_grounding_confidence"), "grounding_confidence_sample", rate(F.col("_l"), F.col("latency_sample"), 2).alias("avg_answer_latency_ms"), "latency_sample")


def call_costs(calls: DataFrame, prices: DataFrame, places: int = 6) -> DataFrame:
    """tokens / 1e6 x price in and out; an unknown model costs 0. ``prices`` is a dimension of some hundred rows."""
    c = F.coalesce(F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out"), F.lit(0.0))
    return calls.join(F.broadcast(prices), "model", "left").withColumn("cost", F.round(c, places)).drop("price_in", "price_out")


def cost_by_agent(costs: DataFrame) -> DataFrame:
    return costs.groupBy("agent").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("total"))


def budget_alert(costs: DataFrame, budget: float) -> DataFrame:
    used = F.sum("cost") / budget
    return costs.agg(F.round(F.sum("cost"), 6).alias("total"), F.round(used, 6).alias("used"), F.when(used >= 1.0, "exceeded").when(used >= 0.8, "warning").otherwise("ok").alias("level"))


def experiment_results(assignments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per variant and metric: users, count, total and mean."""
    users = assignments.groupBy("variant").agg(F.countDistinct("user_id").alias("users"))
    m = metrics.join(assignments, "user_id").groupBy("variant", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"))
    return m.join(users, "variant")


def compare_runs(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Runs side by side: one column per metric, null where a run lacks it."""
    return metrics.groupBy("run").pivot("metric", names).agg(F.first("value"))


def best_run(metrics: DataFrame, metric: str) -> DataFrame:
    return metrics.filter(F.col("metric") == metric).orderBy(F.desc("value"), F.asc("run")).limit(1)


def referral_tiers(referrals: DataFrame, by: str, order: list[str], after: int = 4, low: int = 1, high: int = 3) -> DataFrame:
    """Each reward: ``high`` once ``after`` came before it, else ``low``."""
    keys = ", ".join(order)
    return referrals.withColumn("_n", F.expr(f"row_number() over (partition by {by} order by {keys})")).withColumn("reward", F.when(F.col("_n") > after, high).otherwise(low)).drop("_n")


def windowed_quality(messages: DataFrame, now: Column, hours: int = 24, col: str = "trace", role: str = "role", when: str = "created_at") -> DataFrame:
    """``trace_quality`` of the assistant's messages of the last ``hours``, with the window's length."""
    recent = messages.filter((F.col(role) == "assistant") & (F.col(when) >= now - F.expr(f"interval {int(hours)} hours")))
    return trace_quality(recent, col).withColumn("window_hours", F.lit(hours))


def recent_costs(costs: DataFrame, limit: int = 50, id_col: str = "id") -> DataFrame:
    return costs.orderBy(F.desc(id_col)).limit(limit)


def entries_of_client(ledger: DataFrame, user: Column, client: Column, user_col: str = "user_id", client_col: str = "client_id") -> DataFrame:
    """Number of ledger entries of one client of one user."""
    return ledger.filter((F.col(user_col) == user) & (F.col(client_col) == client)).agg(F.count(F.lit(1)).alias("n"))


def metric_means(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of optional metrics, each over the cases that have it; a null mean where none has."""
    return cases.agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics])


def available_hints(hints: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Active hints (hint_id, active, priority, recurring, max_times) per user of ``states`` (user_id, hint_id, shown,
    snoozed_until): not snoozed at ``now``, recurring ones below their limit (1 unless stated); ``place`` by priority, then id."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "low", 2).otherwise(1)
    open_ = states.join(F.broadcast(hints.filter(F.coalesce("active", F.lit(True)))), "hint_id")  # hints are written by hand
    open_ = open_.filter(F.coalesce(F.col("snoozed_until") <= now, F.lit(True)) & (~F.coalesce("recurring", F.lit(False)) | (F.coalesce("shown", F.lit(0)) < F.coalesce("max_times", F.lit(1)))))
    return open_.withColumn("_k", rank).withColumn("place", F.expr("row_number() over (partition by user_id order by _k, hint_id)")).drop("_k")


def eval_summary(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, pass rate and its Wilson interval; null passes are failures."""
    ok = F.coalesce(F.col("passed"), F.lit(False))
    g = (cases.groupBy(*by) if by else cases.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passes"))
    lo, hi = wilson(F.col("passes"), F.col("n"))
    return g.select(*(by or []), "n", "passes", F.round(F.col("passes") / F.col("n"), 6).alias("rate"), lo.alias("low"), hi.alias("high"))


def judge_summary(cases: DataFrame, sets: list[str], score: str = "score", passing: float = 0.7) -> DataFrame:
    """Mean score and pass share for all cases and by each dimension, in one pass of grouping sets."""
    view = cases.select(*sets, score)
    g = view.groupingSets([[], *[[s] for s in sets]], *sets).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.avg((F.col(score) >= passing).cast("double")), 6).alias("pass_rate"))
    return g


def recall_at(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Ranked hits (query_id, rank from 1, relevant) to the share of queries with a relevant one in the first k."""
    per = ranked.groupBy("query_id").agg(*[F.max((F.col("relevant") & (F.col("rank") <= k)).cast("double")).alias(f"r{k}") for k in ks])
    return per.agg(*[F.round(F.avg(f"r{k}"), 6).alias(f"recall_at_{k}") for k in ks])


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, mean degree, mean weight, and density 2E / N(N - 1) of an undirected graph (our choice)."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    return n.join(F.broadcast(e)).select("nodes", "edges", F.when(F.col("nodes") > 0, F.round(2 * F.col("edges") / F.col("nodes"), 6)).otherwise(0.0).alias("mean_degree"), "mean_weight",
                                         F.when(F.col("nodes") > 1, F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9)).otherwise(0.0).alias("density"))


def edge_types(edges: DataFrame, kind: str = "relation") -> DataFrame:
    """Edges and mean weight per type; edges without a type count as ``related``."""
    return edges.groupBy(F.coalesce(kind, F.lit("related")).alias("relation")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def quota_replay(requests: DataFrame, limit: int, when: str = "ts", order: str = "event_id") -> DataFrame:
    """Requests in order against a daily limit per user: which are granted."""
    return requests.withColumn("granted", F.expr(f"row_number() over (partition by user_id, to_date({when}) order by {when}, {order}) <= {limit}"))


def judge_split(cases: DataFrame, by: str = "judged_by", score: str = "score", passing: float = 0.7) -> DataFrame:
    """Cases judged by a heuristic and by a model, apart: counts, and mean and pass share of the model's (0 without any)."""
    model = F.coalesce(F.col(by) != "heuristic", F.lit(True))
    s = cases.agg(F.count_if(~model).alias("heuristic_cases"), F.count_if(model).alias("llm_cases"), F.sum(F.when(model, F.col(score))).alias("_s"), F.count_if(model & (F.col(score) >= passing)).alias("_p"))
    return s.select("heuristic_cases", "llm_cases", rate(F.coalesce("_s", F.lit(0.0)), F.col("llm_cases"), 6).alias("mean_llm"), rate(F.col("_p"), F.col("llm_cases"), 6).alias("pass_rate_llm"))


def stuck_rows(rows: DataFrame, states: list[str], before: Column, n: int = 5, status: str = "status", when: str = "updated_at", id_col: str = "id") -> DataFrame:
    """The n longest untouched rows in one of ``states`` that were last touched before a time."""
    return rows.filter(F.col(status).isin(states) & (F.col(when) < before)).orderBy(F.asc(when), F.asc(id_col)).limit(n)


def recent_failures(rows: DataFrame, states: list[str], n: int = 5, status: str = "status", when: str = "updated_at", id_col: str = "id") -> DataFrame:
    return rows.filter(F.col(status).isin(states)).orderBy(F.desc(when), F.asc(id_col)).limit(n)


def status_counts(rows: DataFrame, names: list[str], status: str = "status") -> DataFrame:
    """Rows per status; ``names`` without rows count 0, others that occur are kept."""
    known = rows.sparkSession.createDataFrame([(n,) for n in names], "status string")
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(known), "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows per value of an expression: views per page, fallbacks per path."""
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def leaderboard(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    return counts_by(rows, F.col(key), key).orderBy(F.desc("n"), F.asc(key)).limit(n)


def ledger_page(entries: DataFrame, offset: int, n: int, when: str = "ts", id_col: str = "event_id") -> DataFrame:
    """One page of entries, newest first, with the number of all."""
    total = entries.agg(F.count(F.lit(1)).alias("total"))
    return entries.orderBy(F.desc(when), F.desc(id_col)).offset(offset).limit(n).join(F.broadcast(total))
