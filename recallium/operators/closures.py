"""Closures of many roots at once: ancestor pointers that double, and what erasing all those roots takes.

A memory's parent counts only if it is the same user's. Each memory points at its parent; in each round a pointer that
has not reached a root of its user jumps to where its target points. So the rounds grow with the logarithm of the
depth, and all roots share them. A pointer that is still on its way after as many doublings as there are memories is on
a cycle without a root, or leads to one, and ends. The roots above a root are found in the same way, on roots alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.session import shared_dir

MOST = 5000  # a closure above this is refused whole


class _Steps:
    """Tables in the shared folder, one per round."""

    def __init__(self, df: DataFrame):
        self.spark, self.n = df.sparkSession, 0
        self.base = f"{shared_dir(self.spark)}/recallium/closures-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.base}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{self.n}")


def closures(memories: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, user_id, id, depth): all memories below each of ``roots`` (root, user_id), at their depth; a root is not below itself.

    ``memories`` need id, user_id, parent_id. Roots that are no memory of their user have nothing below them. Repeated
    roots count once. Memories are expected once per (user, id).
    """
    steps = _Steps(memories)
    own = memories.filter("id is not null").select("user_id", "id", "parent_id")
    mark = roots.select("user_id", F.col("root").alias("to"), F.lit(True).alias("hit")).distinct()
    first = own.filter("parent_id is not null").select("user_id", "id", F.col("parent_id").alias("to"), F.lit(1).cast("long").alias("dist")).join(mark, ["user_id", "to"], "left").select("user_id", "id", "to", "dist", F.coalesce("hit", F.lit(False)).alias("hit"))
    at = steps.cut(first)
    most = at.count().bit_length() + 1
    for _ in range(most):
        if at.filter("not hit").isEmpty():
            break
        ahead = at.select("user_id", F.col("id").alias("to"), F.col("to").alias("far"), F.col("dist").alias("more"), F.col("hit").alias("far_hit"))
        moving = at.filter("not hit").join(ahead, ["user_id", "to"])  # a target without a parent ends the walk
        moved = moving.select("user_id", "id", F.col("far").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("far_hit").alias("hit"))
        at = steps.cut(at.filter("hit").unionByName(moved))
    nearest = steps.cut(at.filter("hit").select("user_id", "id", "to", "dist"))
    above = nearest.join(mark.select("user_id", F.col("to").alias("id")), ["user_id", "id"], "left_semi")
    every = steps.cut(above.selectExpr("user_id", "id as low", "to as root", "dist"))
    while True:
        next_up = every.selectExpr("user_id", "low as root", "root as far", "dist as more")
        longer = every.join(next_up, ["user_id", "root"]).selectExpr("user_id", "low", "far as root", "dist + more as dist")
        new = steps.cut(every.unionByName(longer).groupBy("user_id", "low", "root").agg(F.min("dist").alias("dist")))
        if new.count() == every.count():
            break
        every = new
    direct = nearest.selectExpr("user_id", "to as root", "id", "dist as depth")
    through = nearest.selectExpr("user_id", "to as low", "id", "dist").join(every, ["user_id", "low"]).select("user_id", "root", "id", (nearest["dist"] + every["dist"]).alias("depth"))
    below = direct.unionByName(through.select("user_id", "root", "id", "depth")).filter("root <> id")
    found = below.groupBy("root", "user_id", "id").agg(F.min("depth").alias("depth"))
    real = own.select("user_id", F.col("id").alias("root")).distinct()
    return found.join(real, ["user_id", "root"], "left_semi").select("root", "user_id", "id", "depth")


def erase_many(memories: DataFrame, roots: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """What erasing ``roots`` takes with it, and a receipt per root.

    The plan has (root, user_id, id, why, depth): the root, its descendants, and one hop of the user's memories that derive
    from any of them. A root whose closure is above ``most`` is refused whole and plans nothing, one that is no memory of
    its user is not found; the others are not touched by that. Receipts: root, user_id, status, closure, depth, derived.
    ``memories`` need id, user_id, parent_id, derived_from.
    """
    asked = roots.select("root", "user_id").distinct()
    below = closures(memories, asked)
    steps = _Steps(memories)
    sizes = below.groupBy("root", "user_id").agg(F.count(F.lit(1)).alias("closure"), F.max("depth").alias("depth"))
    real = memories.select(F.col("id").alias("root"), "user_id").distinct().withColumn("_real", F.lit(True))
    status = F.when(F.col("_real").isNull(), "not_found_or_foreign").when(F.col("closure") > most, "refused").otherwise("planned")
    heads = steps.cut(asked.join(sizes, ["root", "user_id"], "left").join(real, ["root", "user_id"], "left").select("root", "user_id", status.alias("status"), F.coalesce("closure", F.lit(0)).alias("closure"), F.coalesce("depth", F.lit(0)).alias("depth")))
    going = heads.filter("status = 'planned'").select("root", "user_id")
    closure = steps.cut(going.selectExpr("root", "user_id", "root as id", "'root' as why", "0L as depth").unionByName(below.join(going, ["root", "user_id"], "left_semi").selectExpr("root", "user_id", "id", "'descendant' as why", "depth")))
    sources = memories.select("user_id", F.col("id").alias("derived"), F.explode("derived_from").alias("id"))
    derived = sources.join(closure.select("root", "user_id", "id"), ["user_id", "id"]).select("root", "user_id", F.col("derived").alias("id")).distinct()
    derived = derived.join(closure.select("root", "user_id", "id"), ["root", "user_id", "id"], "left_anti").selectExpr("root", "user_id", "id", "'derived' as why", "-1L as depth")
    plan = steps.cut(closure.unionByName(derived))
    extra = plan.filter("why = 'derived'").groupBy("root", "user_id").agg(F.count(F.lit(1)).alias("derived"))
    return plan, heads.join(extra, ["root", "user_id"], "left").select("root", "user_id", "status", "closure", "depth", F.coalesce("derived", F.lit(0)).alias("derived"))


def apply_erase(memories: DataFrame, plan: DataFrame) -> DataFrame:
    """The memories that are left."""
    return memories.join(plan.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def erase_residuals(left: DataFrame, plan: DataFrame) -> DataFrame:
    """Per root, what an erase should have taken and did not: ``rows`` still there, ``children`` whose parent is gone."""
    gone = plan.select("root", "user_id", "id").distinct()
    rows = gone.join(left.select("id", "user_id"), ["id", "user_id"]).groupBy("root", "user_id").agg(F.count(F.lit(1)).alias("rows"))
    under = gone.select("root", "user_id", F.col("id").alias("parent_id")).join(left.select("parent_id"), "parent_id").groupBy("root", "user_id").agg(F.count(F.lit(1)).alias("children"))
    heads = plan.select("root", "user_id").distinct()
    return heads.join(rows, ["root", "user_id"], "left").join(under, ["root", "user_id"], "left").na.fill(0, ["rows", "children"])
