"""Sources kept in a store: fetched items are merged in, and each item says what became of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.sources.stores import BucketStore

ITEM = "source_id string, item_ref string, title string, content string, summary string, url string, captured_at timestamp"
COMPARED = ("title", "content", "summary")


class SourceStore:
    """Memories of connectors by (source, reference). A new reference is revision 1; a change of title, content or summary is
    one more; an unchanged or suppressed item changes nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path
        self.store = BucketStore(spark, f"{path}/memories", ["source_id", "item_ref"], f"{ITEM}, revision long", buckets)

    def sync(self, items: DataFrame, suppressed: DataFrame, batch: int, order: str = "pos") -> DataFrame:
        """Merge ``items`` (the columns of ``ITEM``, and ``order``); ``suppressed`` has source_id, item_ref.

        Returns the items with ``action``: added, updated or skipped. A reference that a batch has twice is added by the first
        and updated by the next one that differs. A batch that comes again returns what it did before. Items without a
        reference, or without content, are an error.
        """
        said = self.store.note("sync") if self.store.done("sync") >= batch else None
        if said is not None and self.store.done("sync") == batch:
            return self.spark.read.parquet(f"{self.path}/{said['path']}")
        if said is not None:
            raise ValueError(f"batch {batch} is older than the last one")
        if not items.filter("item_ref is null or content is null").isEmpty():
            raise ValueError("items without a reference or content")
        names = self.store.schema.names[:-1]
        stored = self.store.read().select("source_id", "item_ref", F.struct(*COMPARED).alias("_old"))
        live = items.select(*names, order).join(suppressed.select("source_id", "item_ref").distinct().withColumn("_s", F.lit(True)), ["source_id", "item_ref"], "left").join(stored, ["source_id", "item_ref"], "left")
        over = "over (partition by source_id, item_ref order by " + order + ")"
        live = live.withColumn("_new", F.struct(*COMPARED)).withColumn("_before", F.coalesce(F.expr(f"lag(_new) {over}"), "_old"))
        action = F.when(F.col("_s"), "skipped").when(F.col("_before").isNull(), "added").when(F.col("_before").eqNullSafe(F.col("_new")), "skipped").otherwise("updated")
        path = f"actions/{batch}-{uuid.uuid4().hex}"
        live.select(*names, order, action.alias("action")).write.parquet(f"{self.path}/{path}")  # decided once, before the store changes
        done = self.spark.read.parquet(f"{self.path}/{path}")
        changed = done.filter("action <> 'skipped'").groupBy("source_id", "item_ref").agg(F.max(F.struct(order, *names[2:])).alias("r"), F.count(F.lit(1)).alias("revision"))
        rows = changed.select("source_id", "item_ref", *[F.col("r")[c].alias(c) for c in names[2:]], "revision")

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            every = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
            best = every.groupBy("source_id", "item_ref").agg(F.max(F.struct("_n", *names[2:])).alias("r"), F.sum("revision").alias("revision"))
            return best.select("source_id", "item_ref", *[F.col("r")[c].alias(c) for c in names[2:]], "revision")

        self.store.merge(rows, combine, "sync", batch, note={"path": path})
        return done

    def read(self) -> DataFrame:
        return self.store.read()
