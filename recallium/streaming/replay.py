"""Streams that are run in legs, and their replay into stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallium.sources.stores import BucketStore, newest


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (dots written as ``__``) for the queries that start inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(stream: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """All that is there now, from where the checkpoint stands. There is no time limit; a failure is raised."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each is not None else writer.format("parquet").option("path", path)
    run = writer.start()
    try:
        run.awaitTermination()
    finally:
        run.stop()


def in_time_slices(table: DataFrame, when: str, slices: int) -> list[DataFrame]:
    """The table cut by time at its quantiles, in order; rows of one time stay together, null times come first."""
    at = F.unix_micros(F.col(when).cast("timestamp"))
    cuts = table.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        low = (at > lo) if lo is not None else F.lit(True)
        high = (at <= hi) if hi is not None else F.lit(True)
        part = table.filter(low & high) if lo is not None else table.filter(at.isNull() | high)
        out.append(part)
    return out


def in_legs(spark: SparkSession, slices: list[DataFrame], base: str, run: Callable[[DataFrame], None]) -> None:
    """Lay each slice down as files of a stream and ``run`` the stream to its end: every leg is a restart."""
    schema: StructType = slices[0].schema
    for part in slices:
        part.write.mode("append").parquet(f"{base}/in")
        run(spark.readStream.schema(schema).parquet(f"{base}/in"))


def replay_into(store: BucketStore, order: list[str], stream: str = "outbox") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: the newest intent of each key, stored or in the batch, stays in the store.

    The store's manifest records the batch with the rows, in one swap; a batch that comes again is passed over. An intent
    of an older revision than the stored one changes nothing, so a late replay cannot bring back what was overwritten.
    """
    def sink(batch: DataFrame, number: int) -> None:
        if store.done(stream) >= number:
            return
        part = batch.select(*store.schema.names)
        empty = batch.sparkSession.createDataFrame([], store.schema)
        store.merge(newest(store.key, order)(empty, part), newest(store.key, order), stream, number)

    return sink
