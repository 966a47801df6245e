"""Joins, timelines, audits, sync and corrections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from recallium.operators import lifecycle as C
from recallium.operators import relational as J
from recallium.plans.adapters import GRAPH, MEM, STATE_SQL, graph, memories, table
from recallium.plans.catalog import query


@query("SELECT o_orderkey AS id, o_orderdate AS captured_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 77 ORDER BY o_orderdate DESC, o_orderkey, l_linenumber LIMIT 20")
def memories_of_entity(spark, d):
    m = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderdate as captured_at")
    links = table(spark, d, "lineitem").selectExpr("l_orderkey as memory_id", "l_partkey as entity_id")
    return J.memories_of_entity(m, links, 77, 20).select("id", "captured_at")


@query("SELECT c_custkey, count(*) AS n, max(o_orderdate) AS last FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def user_activity(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey")
    return J.activity(c, table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderdate")


@query("SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 3) r USING (conv_id) WHERE role = 'assistant'")
def chunks_of_ready_documents(spark, d):
    c = table(spark, d, "conversations")
    ready = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 3").select("conv_id")
    return c.filter("role = 'assistant'").join(ready, "conv_id", "left_semi").select("conv_id", "turn")


@query("SELECT o_orderkey AS id, e.entities FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT lower(p_brand))) AS entities FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) e ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def hydrate_candidates(spark, d):
    m = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey as user_id")
    links = table(spark, d, "lineitem").selectExpr("l_orderkey as memory_id", "l_partkey as entity_id")
    ents = table(spark, d, "part").selectExpr("p_partkey as entity_id", "p_brand as name")
    return J.hydrate(m.select("id"), m, 7, links, ents).select("id", "entities")


@query(f"WITH {GRAPH}, top AS (SELECT node FROM nodes ORDER BY mention_count DESC, node DESC, node LIMIT 300) SELECT source, target, round(weight, 6) AS weight FROM edges WHERE source IN (FROM top) AND target IN (FROM top) ORDER BY weight DESC, source, target LIMIT 600")
def graph_snapshot(spark, d):
    nodes, edges = graph(spark, d)
    ents = nodes.selectExpr("node as entity_id", "name", "mention_count", "node as last_seen")
    return J.graph_snapshot(ents, edges, 300)[1].withColumn("weight", F.round("weight", 6))


@query(f"WITH {GRAPH} SELECT target AS entity_id FROM edges WHERE source = 42 UNION SELECT source FROM edges WHERE target = 42")
def graph_neighbours(spark, d):
    return J.neighbours(graph(spark, d)[1], 42)


@query("WITH gone AS (SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) SELECT c_custkey AS entity_id FROM gone")
def orphan_entities(spark, d):
    ents = table(spark, d, "customer").selectExpr("c_custkey as entity_id")
    links = table(spark, d, "orders").selectExpr("o_custkey as entity_id")
    rel = table(spark, d, "customer").selectExpr("c_custkey as source", "c_nationkey as target")
    return J.orphans(ents, links, rel)[0]


@query("WITH a AS (SELECT ts, event_id FROM events WHERE event_id = 500) SELECT event_id, ts FROM ((SELECT e.event_id, e.ts FROM events e, a WHERE (e.ts, e.event_id) < (a.ts, a.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 5) UNION ALL (SELECT event_id, ts FROM a) UNION ALL (SELECT e.event_id, e.ts FROM events e, a WHERE (e.ts, e.event_id) > (a.ts, a.event_id) ORDER BY e.ts, e.event_id LIMIT 5))")
def timeline(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    row = e.filter("event_id = 500").first()
    at = row.ts if row else datetime(2024, 1, 1)
    return J.timeline(e, F.lit(at).cast("timestamp_ntz"), 500, 5, 5, "ts", "event_id")


@query("SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return J.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("WITH u AS (SELECT c_custkey AS k, c_acctbal AS b, 0 AS p FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, -1.0, 1 FROM customer WHERE c_nationkey < 10) SELECT k, b FROM (SELECT k, b FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY p) = 1) ORDER BY b DESC, k LIMIT 100")
def workspace_union(spark, d):
    c = table(spark, d, "customer")
    a, b = c.filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as k", "c_acctbal as b"), c.filter("c_nationkey < 10").selectExpr("c_custkey as k", "-1.0D as b")
    return J.union_first(a, b, "k", [F.desc("b"), F.asc("k")], 100)


_AUDIT = "s AS (SELECT doc_id AS k, 1 + doc_id % 3 AS r, lang AS f FROM documents), i AS (SELECT doc_id + (CASE WHEN quality = 0 THEN 1000000 ELSE 0 END) AS k, CASE WHEN toxic = 1 THEN NULL ELSE 1 + doc_id % 2 END AS r, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS f FROM labels JOIN documents USING (doc_id)), a AS (SELECT coalesce(s.k, i.k) AS k, CASE WHEN i.k IS NULL THEN 'missing' WHEN s.k IS NULL THEN 'orphan' WHEN i.r IS NULL THEN 'malformed' WHEN i.f <> s.f THEN 'fingerprint' WHEN i.r < s.r THEN 'stale' ELSE 'ok' END AS class FROM s FULL JOIN i ON s.k = i.k)"


def _audit(spark, d):
    docs = table(spark, d, "documents")
    s = docs.selectExpr("doc_id as k", "1 + doc_id % 3 as revision", "lang as fingerprint")
    i = table(spark, d, "labels").join(docs, "doc_id").selectExpr("doc_id + if(quality = 0, 1000000, 0) as k", "if(toxic = 1, null, 1 + doc_id % 2) as revision", "if(doc_id % 10 = 0, 'xx', lang) as fingerprint")
    return J.index_audit(s, i, "k")


@query(f"WITH {_AUDIT} SELECT k, class FROM a")
def index_audit(spark, d):
    return _audit(spark, d)


@query(f"WITH {_AUDIT} SELECT class, count(*) AS n FROM a GROUP BY 1")
def index_audit_rollup(spark, d):
    return _audit(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_SUP = "sup AS (SELECT DISTINCT lang AS user_id, 'ref' || (doc_id % 900) AS source_ref FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)"


def _suppressed(spark, d):
    return table(spark, d, "labels").filter("toxic = 1").join(table(spark, d, "documents"), "doc_id").selectExpr("lang as user_id", "concat('ref', doc_id % 900) as source_ref")


@query(f"WITH {MEM}, {_SUP} SELECT id, CASE WHEN s.source_ref IS NOT NULL THEN 'suppressed' WHEN {STATE_SQL} IN ('superseded', 'dirty') THEN {STATE_SQL} ELSE 'eligible' END AS reason FROM mem LEFT JOIN sup s ON s.user_id = mem.user_id AND s.source_ref = mem.source_ref")
def index_eligibility(spark, d):
    return J.eligibility(memories(spark, d), _suppressed(spark, d)).select("id", "reason")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 200")
def reindex_page(spark, d):
    return J.missing_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", 200)


_SYNC = "old AS (SELECT 'r' || (doc_id * 2) AS source_ref, lang AS title, text AS content FROM documents), new AS (SELECT 'r' || doc_id AS source_ref, lang AS title, text AS content FROM documents), gone AS (SELECT DISTINCT 'r' || doc_id AS source_ref FROM labels WHERE toxic = 1), act AS (SELECT new.source_ref, CASE WHEN g.source_ref IS NOT NULL THEN 'skipped' WHEN old.source_ref IS NOT NULL AND old.title IS NOT DISTINCT FROM new.title AND old.content IS NOT DISTINCT FROM new.content THEN 'skipped' WHEN old.source_ref IS NOT NULL THEN 'updated' ELSE 'added' END AS action FROM new LEFT JOIN old ON old.source_ref = new.source_ref LEFT JOIN gone g ON g.source_ref = new.source_ref)"


def _sync(spark, d):
    docs = table(spark, d, "documents")
    old = docs.selectExpr("concat('r', doc_id * 2) as source_ref", "lang as title", "text as content")
    new = docs.selectExpr("concat('r', doc_id) as source_ref", "lang as title", "text as content")
    gone = table(spark, d, "labels").filter("toxic = 1").selectExpr("concat('r', doc_id) as source_ref")
    return J.sync_actions(old, new, gone)


@query(f"WITH {_SYNC} SELECT source_ref, action FROM act")
def source_upsert(spark, d):
    return _sync(spark, d).select("source_ref", "action")


@query(f"WITH {_SYNC} SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'skipped') AS skipped, max(source_ref) AS cursor FROM act")
def sync_summary(spark, d):
    return J.sync_summary(_sync(spark, d), "source_ref")


_COR = f"""{MEM}, live AS (SELECT user_id, id, assertion, subject || '|' || attribute AS stem, subject || '|' || attribute || '|' || CASE WHEN scope = '' THEN 'default' ELSE scope END AS slot FROM mem WHERE {STATE_SQL} <> 'superseded'),
cor AS (SELECT DISTINCT 'c-' || lang || '-' || (doc_id % 40) || '-' || (doc_id % 3) || '-' || (doc_id % 2) AS correction_id, lang AS user_id, 'subj' || (doc_id % 40) || '|attr ' || (doc_id % 3) AS stem, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'scope9' END AS scope FROM documents),
c2 AS (SELECT *, stem || '|' || CASE WHEN scope = '' THEN 'default' ELSE scope END AS slot FROM cor),
dec AS (SELECT correction_id, user_id, slot, (SELECT count(*) FROM live l WHERE l.user_id = c2.user_id AND l.slot = c2.slot) AS matches,
 CASE WHEN (SELECT count(*) FROM live l WHERE l.user_id = c2.user_id AND l.slot = c2.slot) > 0 THEN CASE WHEN (SELECT count(*) FROM live l WHERE l.user_id = c2.user_id AND l.slot = c2.slot AND l.assertion <> 'fact') = 0 THEN 'superseded' ELSE 'needs-check' END
 WHEN (SELECT count(*) FROM live l WHERE l.user_id = c2.user_id AND l.stem = c2.stem AND l.slot <> c2.slot) > 0 AND scope = '' THEN 'needs-check' ELSE 'added' END AS status FROM c2)"""


def _decisions(spark, d):
    cor = table(spark, d, "documents").selectExpr("concat('c-', lang, '-', doc_id % 40, '-', doc_id % 3, '-', doc_id % 2) as correction_id", "lang as user_id", "concat(' SUBJ', doc_id % 40) as subject", "concat('attr  ', doc_id % 3) as attribute", "if(doc_id % 2 = 0, '', 'scope9') as scope", "'fact' as assertion", "cast(null as bigint) as target_id").distinct()
    return C.decide_corrections(memories(spark, d), cor)


@query(f"WITH {_COR} SELECT * FROM dec")
def correction_decisions(spark, d):
    return _decisions(spark, d)


@query(f"WITH {_COR}, hit AS (SELECT l.id, l.user_id, dec.correction_id FROM live l JOIN dec ON dec.user_id = l.user_id AND dec.slot = l.slot AND dec.status = 'superseded'), dep AS (SELECT DISTINCT m.id FROM (SELECT id, user_id, unnest(derived_from) AS dep FROM mem) m JOIN hit ON hit.id = m.dep AND hit.user_id = m.user_id) SELECT mem.id, coalesce(hit.correction_id, mem.superseded_by::VARCHAR) AS superseded_by, CASE WHEN dep.id IS NOT NULL AND hit.id IS NULL AND {STATE_SQL} NOT IN ('dirty', 'superseded') THEN true ELSE mem.dirty END AS dirty FROM mem LEFT JOIN hit ON hit.id = mem.id LEFT JOIN dep ON dep.id = mem.id")
def correction_apply(spark, d):
    return C.apply_corrections(memories(spark, d), _decisions(spark, d)).select("id", "superseded_by", "dirty")


@query("SELECT doc_id AS id, unnest([doc_id // 2, doc_id // 3]) AS supersedes FROM documents WHERE lang = 'de'")
def supersede_links(spark, d):
    return C.supersede_links(table(spark, d, "documents").selectExpr("doc_id as id", "if(lang = 'de', array(doc_id div 2, doc_id div 3), null) as supersedes"))


_OUT = f"{MEM}, due AS (SELECT * FROM (SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'other' ELSE 'memory' END AS kind, user_id * 8 AS entity_id, 1 + event_id % 3 AS revision, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation, CASE WHEN event_type = 'purchase' THEN 'g0' ELSE 'g1' END AS target_generation, ts FROM events) WHERE ts <= TIMESTAMP '2024-01-20' ORDER BY seq LIMIT 200)"


@query(f"WITH {_OUT} SELECT seq, CASE WHEN kind <> 'memory' OR target_generation <> 'g1' THEN 'blocked' WHEN m.id IS NULL THEN 'delete' WHEN due.revision < m.revision THEN 'skipped' WHEN operation = 'delete' THEN 'delete' ELSE 'upsert' END AS outcome FROM due LEFT JOIN mem m ON m.id = entity_id")
def outbox_drain(spark, d):
    o = table(spark, d, "events").selectExpr("event_id as seq", "if(event_type = 'signup', 'other', 'memory') as kind", "user_id * 8 as entity_id", "1 + event_id % 3 as revision", "if(event_type = 'error', 'delete', 'upsert') as operation", "if(event_type = 'purchase', 'g0', 'g1') as target_generation", "'pending' as status", "ts as next_attempt_at")
    g = spark.createDataFrame([("memory", "g1"), ("chunk", "g1")], "kind string, generation string")
    return C.drain(o, memories(spark, d), g, F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'"), 200).select("seq", "outcome")


@query("SELECT DISTINCT event_type AS kind, user_id AS entity_id, event_id % 3 AS revision FROM events WHERE NOT (event_type = 'view' AND event_id % 3 = 0)")
def outbox_enqueue(spark, d):
    i = table(spark, d, "events").selectExpr("event_type as kind", "user_id as entity_id", "event_id % 3 as revision", "'upsert' as operation", "'g1' as target_generation")
    return C.enqueue(i.filter("kind = 'view' and revision = 0"), i).select("kind", "entity_id", "revision")


@query("WITH t AS (SELECT conv_id AS q, role = 'user' AS forget, length(text) % 2 = 0 AS kept FROM conversations WHERE role <> 'system') SELECT q AS question_id, count(*) FILTER (forget AND kept) AS not_forgotten, count(*) FILTER (NOT forget AND NOT kept) AS lost, count(*) FILTER (forget AND kept) = 0 AND count(*) FILTER (NOT forget AND NOT kept) = 0 AS passed FROM t GROUP BY 1")
def forgetting_check(spark, d):
    c = table(spark, d, "conversations").filter("role <> 'system'").selectExpr("conv_id as question_id", "concat(conv_id, '-', turn) as turn_id", "role = 'user' as forget", "length(text) % 2 = 0 as kept")
    return C.forgetting_check(c.drop("kept"), c.filter("kept").select("turn_id"), c.select("question_id").distinct())
