"""Entity extraction, co-mention relations, graph upkeep, components, closures."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.functions import text as T
from recallium.session import shared_dir


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/recallium/graph-{uuid.uuid4().hex}"


def _cut(df: DataFrame, base: str, n: int) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and survives lost executors."""
    df.write.parquet(f"{base}/{n}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{n}")


def extract_entities(docs: DataFrame, id_col: str, text_col: str, tags_col: str | None = None, most: int = 12) -> DataFrame:
    """Tags (topic, .55), dates (.5) and capitalised phrases (.45, ``project`` by their head): per document and
    (lower-case name, type) the best, at most ``most`` by salience, then order of appearance."""
    one = lambda names, kind, s, group: F.transform(names, lambda n, i: F.struct(T.entity_name(n).alias("name"), (kind(T.entity_name(n)) if callable(kind) else F.lit(kind)).alias("type"), F.lit(s).alias("salience"), (F.lit(group * 1_000_000) + i).alias("pos")))
    project = lambda n: F.when(F.startswith(F.lower(n), F.lit("project ")), "project").otherwise("other")
    c = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(one(F.col(tags_col), "topic", 0.55, 0) if tags_col else F.array().cast("array<struct<name:string,type:string,salience:double,pos:int>>"), one(T.dates(c), "date", 0.5, 1), one(T.phrases(c), project, 0.45, 2))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("e")).select("id", "e.*").filter((F.length("name") >= F.when(F.col("salience") == 0.45, 3).otherwise(1)) & ~((F.col("salience") == 0.45) & F.lower("name").isin("the", "and", "for")))
    best = rows.groupBy("id", F.lower("name").alias("key"), "type").agg(F.min(F.struct((-F.col("salience")).alias("s"), "pos", "name")).alias("b"))
    ranked = best.select("id", F.col("b.name").alias("name"), "type", (-F.col("b.s")).alias("salience"), F.col("b.pos").alias("pos")).withColumn("rank", F.expr("row_number() over (partition by id order by salience desc, pos)"))
    return ranked.filter(F.col("rank") <= most).drop("pos")


def co_mentions(entities: DataFrame, top: int = 8, most: int = 24) -> DataFrame:
    """Pairs among a document's first entities, earlier to later: weight min(.8, .35 + (s1 + s2) / 4)."""
    e = entities.filter(F.col("rank") <= top)
    per = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "salience"))).alias("l"))  # at most `top` each
    pair = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, top), lambda b: F.struct(a["name"].alias("source"), b["name"].alias("target"), F.round(F.least(F.lit(0.8), 0.35 + (a["salience"] + b["salience"]) / 4), 6).alias("weight"), (i * 100 + b["rank"]).alias("pos")))))
    rows = per.select("id", F.explode(pair).alias("p")).select("id", "p.*").filter(F.lower("source") != F.lower("target"))
    best = rows.groupBy("id", F.lower("source").alias("a"), F.lower("target").alias("b")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "pos", "source", "target")).alias("m"))
    return best.select("id", F.col("m.source").alias("source"), F.col("m.target").alias("target"), (-F.col("m.w")).alias("weight"), F.expr("row_number() over (partition by id order by m)").alias("rank")).filter(F.col("rank") <= most)


def upsert_graph(mentions: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch's entities (mentions by distinct document, salience max, seen min and max) and relations (weight max, evidence)."""
    ent = mentions.groupBy(F.lower("name").alias("key"), "type").agg(F.countDistinct("id").alias("mention_count"), F.max("salience").alias("salience"), F.min("id").alias("first_seen"), F.max("id").alias("last_seen"))
    rel = pairs.groupBy(F.lower("source").alias("source"), F.lower("target").alias("target")).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("evidence_count"))
    return ent, rel


def merge_links(stored: DataFrame, mentions: DataFrame, processed: DataFrame, force: bool = False, parts: int | None = None) -> DataFrame:
    """Links (id, key, type, salience) after a batch of mentions (id, name, type, salience): the greater salience, and
    ``new`` where none was stored. Memories in ``processed`` (id) are passed over unless ``force``.
    ``parts`` is the number of tasks that all rows are dealt to by their id; it should grow with them."""
    if parts:
        mentions, processed = mentions.repartition(parts, "id"), processed.repartition(parts, "id")
    fresh = mentions if force else mentions.join(processed.select("id").distinct(), "id", "left_anti")
    rows = stored.select("id", "key", "type", "salience", F.lit(True).alias("_s")).unionByName(fresh.select("id", F.lower("name").alias("key"), "type", "salience", F.lit(False).alias("_s")))
    rows = rows.repartition(parts, "id") if parts else rows
    return rows.groupBy("id", "key", "type").agg(F.max(F.coalesce("salience", F.lit(0.0))).alias("salience"), (~F.max("_s")).alias("new"))


def components(nodes: DataFrame, edges: DataFrame, least_weight: float = 0.2) -> DataFrame:
    """(node, comp): the least node reachable over edges of enough weight; single nodes are their own.

    Labels take the least neighbour's and then jump to their label's label, so rounds grow with the logarithm of a
    path's length; each round is cut to the shared folder.
    """
    spark, base, n = nodes.sparkSession, _shared(nodes.sparkSession), 0
    e = edges.filter((F.col("weight") >= least_weight) & (F.col("source") != F.col("target")))
    both = _cut(e.select(F.col("source").alias("a"), F.col("target").alias("b")).union(e.select("target", "source")).distinct(), base, n)
    label = nodes.select("node", F.col("node").alias("comp"))
    while True:
        n += 1
        least = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = label.join(least, "node", "left").select("node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("new"))
        jump = step.join(step.select(F.col("node").alias("new"), F.col("new").alias("far")), "new").select("node", F.least("new", "far").alias("comp"), (F.least("new", "far") != F.col("comp")).alias("moved"))
        done = _cut(jump, base, n)
        label = done.select("node", "comp")
        if done.filter("moved").isEmpty():
            return label


def clusters(nodes: DataFrame, edges: DataFrame, least_weight: float = 0.2, n: int = 20) -> DataFrame:
    """Components by score (weights plus a tenth of all mentions, to four places), then size; named by their most mentioned node."""
    comp = components(nodes, edges, least_weight)
    labelled = nodes.join(comp, "node")
    inside = edges.filter(F.col("weight") >= least_weight).join(comp.withColumnRenamed("node", "source"), "source").groupBy("comp").agg(F.sum("weight").alias("w"))
    per = labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.sum("mention_count").alias("mentions"), F.max(F.struct("mention_count", "name", "node")).alias("top"))
    return per.join(inside, "comp", "left").select("comp", "size", F.round(F.coalesce("w", F.lit(0.0)) + F.col("mentions") / 10, 4).alias("score"), F.col("top.node").alias("named_by")).orderBy(F.desc("score"), F.desc("size"), F.asc("comp")).limit(n)


def descendants(memories: DataFrame, root: int, user_id: int, most: int = 5000) -> tuple[DataFrame, int, bool]:
    """All rows below ``root`` by parent_id that belong to the user: (id, depth), depth reached, whether it was refused.

    Cycles end at rows already visited. Over ``most`` rows the walk is given up and reported, never cut short quietly.
    """
    spark = memories.sparkSession
    own = memories.filter(F.col("user_id") == user_id).select("id", "parent_id")
    seen = spark.createDataFrame([(root, 0)], "id long, depth int")
    frontier, depth, base = seen, 0, _shared(spark)
    while True:
        nxt = own.join(frontier.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth + 1))
        nxt = _cut(nxt, base, depth)
        if nxt.isEmpty():
            return seen.filter("depth > 0"), depth, False
        depth += 1
        seen, frontier = seen.unionByName(nxt), nxt
        if seen.count() - 1 > most:
            return seen.filter("depth > 0"), depth, True


def derived_from(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories that derive from any of the ids, one hop, those ids left out."""
    deps = memories.select("id", F.explode("derived_from").alias("dep"))
    return deps.join(ids.select(F.col("id").alias("dep")), "dep", "left_semi").select("id").distinct().join(ids.select("id"), "id", "left_anti")


def erase_plan(memories: DataFrame, root: int, user_id: int) -> DataFrame:
    """What erasing a memory takes with it: (id, why, depth)."""
    below, _, refused = descendants(memories, root, user_id)
    if refused:
        raise ValueError("the closure is too large to be erased whole")
    own = memories.filter(F.col("user_id") == user_id)
    closure = own.filter(F.col("id") == root).select("id", F.lit("root").alias("why"), F.lit(0).alias("depth")).unionByName(below.select("id", F.lit("descendant").alias("why"), "depth"))
    derived = derived_from(own, closure.select("id")).select("id", F.lit("derived").alias("why"), F.lit(-1).alias("depth"))
    return closure.unionByName(derived)


def erase_effects(memories: DataFrame, entities: DataFrame, links: DataFrame, plan: DataFrame, root: int, user_id: int) -> DataFrame:
    """What an erase plan leaves behind or takes from others, in one row: children of erased rows that are another user's
    or that the plan leaves, the root's entity links, and the user's entities that no link would be left of."""
    ids = plan.select("id").distinct()
    below = memories.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").join(ids.withColumn("_in", F.lit(True)), "id", "left")
    mine = F.col("user_id") == user_id
    children = below.agg(F.count_if(~mine).alias("cross_user_children"), F.count_if(mine & F.col("_in").isNull()).alias("children"))
    linked = links.filter(F.col("memory_id") == root).agg(F.count(F.lit(1)).alias("entity_links"))
    left = links.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select("entity_id").distinct()
    gone = entities.filter(mine).join(left, "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_entities"))
    return children.join(F.broadcast(linked)).join(F.broadcast(gone))  # one row each


def receipt_status(errors: Column, residual: Column, unverified: Column) -> Column:
    return F.when(errors > 0, "error").when(residual > 0, "residual").when(unverified > 0, "unverified").otherwise("completed")
