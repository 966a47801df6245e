"""Batch forms of the stateful operators, and a stream run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recallium.plans.adapters import table
from recallium.plans.catalog import query
from recallium.session import shared_dir
from recallium.streaming import streams as S
from recallium.streaming.replay import run_to_end


@query("SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)")
def rate_limit(spark, d):
    return S.rate_limited(table(spark, d, "events"), 3600, 3).select("event_id", "in_window", "limited")


@query("SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_windows(spark, d):
    w = S.windowed_counts(table(spark, d, "events"), "1 day", "1 hour")
    return w.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT event_type, user_id AS entity_id, arg_max(event_id, (event_id % 3, event_id)) AS seq FROM events GROUP BY 1, 2")
def outbox_replay(spark, d):
    """The sink of the replaying stream, applied to one batch."""
    got = []
    e = table(spark, d, "events").selectExpr("event_type", "user_id as entity_id", "event_id % 3 as revision", "event_id as seq")
    S.replay_outbox(got.append, ["event_type", "entity_id"])(e, 0)
    return got[0].select("event_type", "entity_id", "seq")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, d):
    """Events read as a stream of files to its end, counted by type in a table of the shared folder."""
    base = f"{shared_dir(spark)}/recallium/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    run_to_end(source.select("event_type"), f"{base}/check", f"{base}/out")
    return spark.read.schema("event_type string").parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
