"""A stored graph that batches of mentions and relations are merged into.

Three keyed stores: links (memory to entity), entities, relations. What a batch adds to the counts depends on the links
that were there before it; so entities and relations are merged first, links last, each with the batch's number. A
batch that is broken off and comes again finds done what is done, and the links as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.sources.stores import BucketStore

LINKS = "user_id string, memory_id long, name string, type string, salience double"
ENTITIES = "user_id string, name string, type string, label string, mention_count long, first_seen timestamp, last_seen timestamp"
RELATIONS = "user_id string, source string, target string, relation string, weight double, evidence_count long, last_evidence timestamp"


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.links = BucketStore(spark, f"{path}/links", ["user_id", "memory_id", "name", "type"], LINKS, buckets)
        self.entities = BucketStore(spark, f"{path}/entities", ["user_id", "name", "type"], ENTITIES, buckets)
        self.relations = BucketStore(spark, f"{path}/relations", ["user_id", "source", "target", "relation"], RELATIONS, buckets)

    def merge(self, mentions: DataFrame, relations: DataFrame, batch: int) -> None:
        """``mentions`` (user_id, memory_id, name, type, salience, captured_at), ``relations`` (user_id, memory_id, source,
        target, relation, weight, captured_at) of memories that were not processed before.

        Names are held by their lower case; an entity's label is the first one seen. An entity's count grows by its new
        links, its times span those of its memories. A relation's weight is the greatest, its evidence grows by one for
        each time it is given, its last evidence is that of the batch's last memory. Relations of an entity with itself
        are left out.
        """
        m = mentions.withColumn("label", F.col("name")).withColumn("name", F.lower("name"))
        key = self.links.key
        given = m.groupBy(*key).agg(F.max(F.coalesce("salience", F.lit(0.0))).alias("salience"))
        new = given.join(self.links.read().select(*key), key, "left_anti").groupBy("user_id", "name", "type").agg(F.count(F.lit(1)).alias("mention_count"))
        seen = m.groupBy("user_id", "name", "type").agg(F.min_by("label", F.struct("captured_at", "memory_id")).alias("label"), F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))
        self.entities.merge(seen.join(new, ["user_id", "name", "type"], "left").na.fill(0, ["mention_count"]), _entities, "graph", batch)
        r = relations.withColumns({"source": F.lower("source"), "target": F.lower("target")}).filter("source <> target")
        given_r = r.groupBy(*self.relations.key).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("evidence_count"), F.max_by("captured_at", "memory_id").alias("last_evidence"))
        self.relations.merge(given_r, _relations, "graph", batch)
        self.links.merge(given, _links, "graph", batch)


def _tagged(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Both, with ``_new`` 0 for stored rows and 1 for the batch's."""
    return stored.withColumn("_new", F.lit(0)).unionByName(changes.select(*stored.columns).withColumn("_new", F.lit(1)))


def _entities(stored: DataFrame, changes: DataFrame) -> DataFrame:
    return _tagged(stored, changes).groupBy("user_id", "name", "type").agg(F.min_by("label", "_new").alias("label"), F.sum("mention_count").alias("mention_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def _relations(stored: DataFrame, changes: DataFrame) -> DataFrame:
    return _tagged(stored, changes).groupBy("user_id", "source", "target", "relation").agg(F.max("weight").alias("weight"), F.sum("evidence_count").alias("evidence_count"), F.max_by("last_evidence", "_new").alias("last_evidence"))


def _links(stored: DataFrame, changes: DataFrame) -> DataFrame:
    return _tagged(stored, changes).groupBy("user_id", "memory_id", "name", "type").agg(F.max("salience").alias("salience"))
