"""Joins, windows around rows, audits and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memories_of_entity(memories: DataFrame, links: DataFrame, entity_id: int, n: int) -> DataFrame:
    return memories.join(links.filter(F.col("entity_id") == entity_id).select(F.col("memory_id").alias("id")), "id").orderBy(F.desc("captured_at"), F.asc("id")).limit(n)


def activity(parents: DataFrame, children: DataFrame, key: str, when: str) -> DataFrame:
    """Per parent: how many children and the last one's time."""
    return parents.join(children.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("last")), key)


def hydrate(candidates: DataFrame, memories: DataFrame, user_id: int, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows behind candidate ids, the tenant checked again, missing ones dropped, with lower-case entity names."""
    names = links.join(entities, "entity_id").groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_set(F.lower("name"))).alias("entities"))
    return candidates.join(memories.filter(F.col("user_id") == user_id), "id").join(names, "id", "left")


def graph_snapshot(entities: DataFrame, relations: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n most mentioned entities and at most 2n relations, heaviest first, with both ends among them."""
    top = entities.orderBy(F.desc("mention_count"), F.desc("last_seen"), F.asc("entity_id")).limit(n)
    ids = top.select("entity_id")
    inside = relations.join(ids.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("entity_id", "target"), "target", "left_semi")
    return top, inside.orderBy(F.desc("weight"), F.asc("source"), F.asc("target")).limit(2 * n)


def neighbours(relations: DataFrame, entity_id: int) -> DataFrame:
    out = relations.filter(F.col("source") == entity_id).select(F.col("target").alias("entity_id"))
    back = relations.filter(F.col("target") == entity_id).select(F.col("source").alias("entity_id"))
    return out.union(back).distinct()


def orphans(entities: DataFrame, links: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without a link, and the relations that touch one."""
    gone = entities.join(links.select("entity_id").distinct(), "entity_id", "left_anti")
    ids = gone.select("entity_id")
    touched = relations.join(ids.withColumnRenamed("entity_id", "source"), "source", "left_semi").unionByName(
        relations.join(ids.withColumnRenamed("entity_id", "target"), "target", "left_semi").select(*relations.columns)).distinct()
    return gone, touched


def timeline(rows: DataFrame, anchor_time: Column, anchor_id: int, before: int, after: int, time_col: str = "captured_at", id_col: str = "id") -> DataFrame:
    """The rows around an anchor in (time, id) order, oldest first, the anchor itself included."""
    key, at = F.struct(time_col, id_col), F.struct(anchor_time.alias(time_col), F.lit(anchor_id).cast("long").alias(id_col))
    earlier = rows.filter(key < at).orderBy(F.desc(time_col), F.desc(id_col)).limit(before)
    later = rows.filter(key > at).orderBy(F.asc(time_col), F.asc(id_col)).limit(after)
    return earlier.unionByName(rows.filter(key == at)).unionByName(later).orderBy(time_col, id_col)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The least row of each key by ``order``; partial aggregation keeps one row per key and task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(*[c if c in keys else F.col("_r")[c].alias(c) for c in rows.columns])


def index_audit(store: DataFrame, index: DataFrame, key: str, fingerprint: str = "fingerprint", revision: str = "revision") -> DataFrame:
    """Per key the class of disagreement between the store and its index."""
    s = store.select(F.col(key), F.col(revision).alias("_sr"), F.col(fingerprint).alias("_sf"), F.lit(True).alias("_s"))
    i = index.select(F.col(key), F.col(revision).alias("_ir"), F.col(fingerprint).alias("_if"), F.lit(True).alias("_i"))
    kind = (F.when(F.col("_i").isNull(), "missing").when(F.col("_s").isNull(), "orphan").when(F.col("_ir").isNull(), "malformed")
            .when(F.col("_if") != F.col("_sf"), "fingerprint").when(F.col("_ir") < F.col("_sr"), "stale").otherwise("ok"))
    return s.join(i, key, "full_outer").select(key, kind.alias("class"))


def audit_findings(store: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """All findings of a comparison of store rows (key, revision, fingerprint, tenant, reason; a reason means that the row
    must not be indexed) with index points (key, revision, fingerprint, tenant): (key, finding, tenant of the row, tenant of the point).

    A point without a revision or tenant cannot be named and is only ``malformed_id``. A point may have several of
    ``unknown_fingerprint``, ``orphan``, ``excluded_present``, ``stale`` and ``tenant_mismatch``.
    """
    s = store.select(key, *[F.col(c).alias(f"_s{c}") for c in ("revision", "fingerprint", "tenant", "reason")], F.lit(True).alias("_s"))
    i = index.select(key, *[F.col(c).alias(f"_i{c}") for c in ("revision", "fingerprint", "tenant")], F.lit(True).alias("_i"))
    row, point, fit = F.col("_s").isNotNull(), F.col("_i").isNotNull(), F.col("_sreason").isNull()
    found = F.array(
        F.when(point & ~F.col("_ifingerprint").eqNullSafe(F.coalesce("_sfingerprint", "_ifingerprint")), "unknown_fingerprint"), F.when(point & ~row, "orphan"), F.when(point & row & ~fit, "excluded_present"),
        F.when(point & row & fit & ~F.col("_irevision").eqNullSafe(F.col("_srevision")), "stale"), F.when(point & row & fit & ~F.col("_itenant").eqNullSafe(F.col("_stenant")), "tenant_mismatch"), F.when(row & fit & ~point, "missing"))
    odd = point & (F.col("_irevision").isNull() | F.col("_itenant").isNull())
    return s.join(i, key, "full_outer").withColumn("finding", F.explode(F.when(odd, F.array(F.lit("malformed_id"))).otherwise(F.array_compact(found)))).select(key, "finding", F.col("_stenant").alias("tenant"), F.col("_itenant").alias("point_tenant"))


def tenant_report(store: DataFrame, index: DataFrame, findings: DataFrame) -> DataFrame:
    """Per tenant: total, eligible, points, missing, stale, orphan; a row or point without a tenant counts under ``unknown``."""
    names = ("total", "eligible", "points", "missing", "stale", "orphan")
    of = lambda df, tenant, **one: df.select(F.coalesce(tenant, F.lit("unknown")).alias("tenant"), *[one.get(n, F.lit(0)).cast("long").alias(n) for n in names])
    is_ = lambda n: (F.col("finding") == n).cast("int")
    rows = of(store, F.col("tenant"), total=F.lit(1), eligible=F.col("reason").isNull().cast("int"))
    rows = rows.unionByName(of(index, F.col("tenant"), points=F.lit(1)))
    rows = rows.unionByName(of(findings, F.when(F.col("finding") == "orphan", F.col("point_tenant")).otherwise(F.col("tenant")), missing=is_("missing"), stale=is_("stale"), orphan=is_("orphan")))
    return rows.groupBy("tenant").agg(*[F.sum(n).alias(n) for n in names])


def missing_ids(store: DataFrame, index: DataFrame, key: str, page: int) -> DataFrame:
    return store.select(key).join(index.select(key), key, "left_anti").orderBy(key).limit(page)


def eligibility(memories: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Why a memory is left out of an index, or ``eligible``."""
    from recallium.functions.filters import state

    s = suppressed.select("user_id", "source_ref").distinct().withColumn("_x", F.lit(True))
    return memories.join(s, ["user_id", "source_ref"], "left").withColumn("reason", F.when(F.col("_x"), "suppressed").when(state() == "superseded", "superseded").when(state() == "dirty", "dirty").otherwise("eligible")).drop("_x")


def union_first(first: DataFrame, second: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Rows of both by key, those of the first winning."""
    every = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    one = every.groupBy(key).agg(F.min(F.struct("_p", *rest)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])
    return one.orderBy(*order).limit(n)


def sync_actions(existing: DataFrame, incoming: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Per incoming item: ``skipped`` (suppressed or unchanged), ``updated`` or ``added``. Title, content and, where both
    sides have it, summary are compared."""
    summed = "summary" in existing.columns and "summary" in incoming.columns
    old = existing.select("source_ref", F.col("title").alias("_t"), F.col("content").alias("_c"), *([F.col("summary").alias("_m")] if summed else []), F.lit(True).alias("_e"))
    sup = suppressed.select("source_ref").distinct().withColumn("_s", F.lit(True))
    same = F.col("_t").eqNullSafe(F.col("title")) & F.col("_c").eqNullSafe(F.col("content")) & (F.col("_m").eqNullSafe(F.col("summary")) if summed else F.lit(True))
    action = F.when(F.col("_s"), "skipped").when(F.col("_e") & same, "skipped").when(F.col("_e"), "updated").otherwise("added")
    return incoming.join(old, "source_ref", "left").join(sup, "source_ref", "left").withColumn("action", action).drop("_t", "_c", "_m", "_e", "_s")


def sync_summary(actions: DataFrame, cursor: str) -> DataFrame:
    """Counts per action; the cursor moves only if there is a value to move it to."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(n("added"), n("updated"), n("skipped"), F.max(cursor).alias("cursor"))


RUNS = "(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))"  # each word with the two after it


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """(``doc_id``, ``item_id``) where the item's text stands anywhere in the document's; both texts have one space between words.

    The words between an item's first and last stand whole in each document that contains it. So an item of five words
    at least is probed by three of those, the longest such run, with an equi-join, and only the documents that have
    the run are searched. Shorter items (none in most sets) are held against all texts. Null texts contain nothing and
    are contained in nothing; rows repeated on either side give repeated rows.
    """
    d = docs.select(F.col(doc_id).alias("_d"), F.col(doc_text).alias("_t"))
    i = items.select(F.col(item_id).alias("_i"), F.col(item_text).alias("_b"), F.regexp_extract_all(F.col(item_text), F.lit(RUNS), F.lit(1)).alias("_w"))
    inner = F.expr("slice(_w, 2, greatest(size(_w) - 2, 0))")
    longest = F.array_max(F.transform(inner, lambda r: F.struct(F.length(r).alias("n"), r.alias("key"))))["key"]
    probed = i.filter("size(_w) > 2").select("_i", "_b", longest.alias("_k"))
    found = d.select("_d", F.explode(F.regexp_extract_all("_t", F.lit(RUNS), F.lit(1))).alias("_k"))
    hits = found.join(probed.select("_k").distinct(), "_k").distinct()
    texts = d.join(hits.withColumnRenamed("_d", "_h"), F.col("_d").eqNullSafe(F.col("_h")))
    out = texts.join(probed, "_k").filter(F.contains("_t", "_b"))
    short = i.filter("size(_w) <= 2")
    few = d.join(short, F.contains("_t", "_b"))
    return out.select("_d", "_i").unionByName(few.select("_d", "_i")).toDF(doc_id, item_id)
