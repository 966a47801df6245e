"""Stateful and incremental forms: rate limits, cursors, outbox replay, expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rate_limited(events: DataFrame, seconds: int, limit: int, user: str = "user_id", when: str = "ts") -> DataFrame:
    """Batch form of a sliding log: each event's count in the last seconds, itself included, and whether it passes the limit."""
    n = F.expr(f"count(1) over (partition by {user} order by unix_micros(cast({when} as timestamp)) range between {seconds * 1_000_000} preceding and current row)")
    return events.withColumn("in_window", n).withColumn("limited", F.col("in_window") > limit)


def event_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """Files as they arrive; the checkpoint keeps what was read, as a cursor does."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str, late: str, when: str = "ts", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Tumbling counts with a watermark (an extension of ours)."""
    return events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late).groupBy(F.window(when, width), *by).agg(F.count(F.lit(1)).alias("n"))


def distinct_within(events: DataFrame, keys: list[str], ttl: str, when: str = "ts") -> DataFrame:
    """A key is let through once within the time to live."""
    return events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, ttl).dropDuplicatesWithinWatermark(keys)


def replay_outbox(apply: Callable[[DataFrame], None], key: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that applies the newest intent of each key; applying a batch again changes nothing."""
    def sink(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        order = ["revision", "seq", *[c for c in rest if c not in ("revision", "seq")]]
        newest = batch.groupBy(*key).agg(F.max(F.struct(*order)).alias("_r")).select(*[c if c in key else F.col("_r")[c].alias(c) for c in batch.columns])
        apply(newest)

    return sink
