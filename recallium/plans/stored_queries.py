"""Stored tables, indexes, streams with restarts, closures of many roots: what outlives one query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recallium.functions import scoring as S
from recallium.operators import closures as C
from recallium.operators.graph_store import GraphStore
from recallium.operators.text_index import TextIndex
from recallium.operators.vector_index import VectorIndex, exact_nearest, recall_against
from recallium.plans.adapters import MEM, memories, table
from recallium.plans.catalog import query
from recallium.plans.ranking_queries import _BM25, _QUERIES
from recallium.session import shared_dir
from recallium.sources import spools
from recallium.sources.backfill import Backfill
from recallium.sources.stores import BucketStore, Folder
from recallium.streaming.capture import captured_files
from recallium.streaming.limits import ROCKSDB, rate_limited_stream
from recallium.streaming.replay import in_legs, in_time_slices, replay_into, run_to_end, settings


def _base(spark, name):
    return f"{shared_dir(spark)}/recallium/{name}-{uuid.uuid4().hex}"


_STATE = {"spark__sql__streaming__stateStore__providerClass": ROCKSDB}


@query("SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)")
def rate_limit_stream(spark, d):
    """The events as a stream in three legs, each a restart from the checkpoint; the state of a user goes over it."""
    base = _base(spark, "limits")
    with settings(spark, **_STATE):
        in_legs(spark, in_time_slices(table(spark, d, "events"), "ts", 3), base, lambda s: run_to_end(rate_limited_stream(s, 3600, 3), f"{base}/check", f"{base}/out"))
    return spark.read.schema("event_id long, in_window long, limited boolean").parquet(f"{base}/out")


@query("SELECT event_type, user_id AS entity_id, max(event_id % 3) AS revision, arg_max(event_id, (event_id % 3, event_id)) AS seq FROM events GROUP BY 1, 2")
def outbox_replay_stored(spark, d):
    """Intents as a stream in three legs into a stored table; a later leg's older revisions change nothing."""
    base = _base(spark, "outbox")
    store = BucketStore(spark, f"{base}/store", ["event_type", "entity_id"], "event_type string, entity_id long, revision long, seq long", buckets=4)
    intents = table(spark, d, "events").selectExpr("ts", "event_type", "user_id as entity_id", "event_id % 3 as revision", "event_id as seq")
    in_legs(spark, in_time_slices(intents, "ts", 3), base, lambda s: run_to_end(s, f"{base}/check", each=replay_into(store, ["revision", "seq"])))
    return store.read()


def _asked(spark, d):
    points = table(spark, d, "embeddings").selectExpr("vec_id as id", "embedding as vector")
    return points, points.filter("id % 20 = 0")


@query("SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10")
def vector_exact_top_k(spark, d):
    """Ten nearest of each row whose id is divisible by 20, all rows against all queries by blocks."""
    points, asked = _asked(spark, d)
    return exact_nearest(points, asked.selectExpr("id as query_id", "vector as q"), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, 10 * count(*) FILTER (vec_id % 20 = 0) AS pairs, true AS enough FROM embeddings")
def vector_index_recall(spark, d):
    """Recall at 10 of the cells' index against the exact search, over all rows whose id is divisible by 20; ``enough`` is 0.9 or more."""
    points, asked = _asked(spark, d)
    index = VectorIndex(spark, _base(spark, "cells")).build(points, "id", "vector")
    found = index.search(asked, 10)
    truth = exact_nearest(points, asked.selectExpr("id as query_id", "vector as q"), 10)
    return recall_against(found, truth).select("queries", "pairs", (F.col("recall") >= 0.9).alias("enough"))


@query()
def vector_index_top_k(spark, d):
    """Ten nearest by the cells' index, of rows with an even label only; scores are exact, the tests compare them."""
    points = table(spark, d, "embeddings").selectExpr("vec_id as id", "embedding as vector", "label")
    index = VectorIndex(spark, _base(spark, "cells")).build(points, "id", "vector")
    return index.search(points.filter("id % 20 = 0"), 10, where=F.col("label") % 2 == 0).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_BM25 + " SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s WHERE score > 0 QUALIFY rank < 20")
def bm25_indexed(spark, d):
    """BM25 on a stored index: built here, then searched by the terms' blocks alone."""
    index = TextIndex(spark, _base(spark, "text")).build(table(spark, d, "documents"), "doc_id", "text", group_docs=256)
    return index.search(spark.createDataFrame(_QUERIES, "query_id int, text string"), 20)


_MENTIONS = ("m AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS user_id, o_orderkey AS memory_id, o_orderpriority AS name, lower(o_orderpriority) AS k, o_totalprice / 1e6 AS salience, o_orderdate AS seen, o_orderstatus = 'F' AS one, c_mktsegment AS seg "
             "FROM orders JOIN customer ON c_custkey = o_custkey)")


def _graph(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    m = o.join(c, F.expr("c_custkey = o_custkey")).selectExpr("if(c_custkey % 3 = 0, 'a', 'b') as user_id", "o_orderkey as memory_id", "o_orderpriority as name", "'priority' as type", "o_totalprice / 1e6D as salience", "cast(o_orderdate as timestamp) as captured_at", "o_orderstatus = 'F' as one", "c_mktsegment as seg")
    store = GraphStore(spark, _base(spark, "graph"), 4)
    for batch, keep in enumerate((F.col("one"), ~F.col("one"), ~F.col("one"))):  # the last batch comes twice
        part = m.filter(keep)
        store.merge(part, part.selectExpr("user_id", "memory_id", "name as source", "seg as target", "'of' as relation", "salience as weight", "captured_at"), min(batch, 1))
    return store


@query(f"WITH {_MENTIONS} SELECT user_id, k AS name, count(*) AS mention_count, min(seen)::TIMESTAMP AS first_seen, max(seen)::TIMESTAMP AS last_seen FROM m GROUP BY 1, 2")
def graph_store_entities(spark, d):
    """Two batches of mentions, the second one given twice, merged into stored entities."""
    e = _graph(spark, d).entities.read()
    return e.select("user_id", "name", "mention_count", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query(f"WITH {_MENTIONS} SELECT user_id, k AS source, lower(seg) AS target, round(max(salience), 6) AS weight, count(*) AS evidence_count, arg_max(seen, memory_id) FILTER (one = last2)::TIMESTAMP AS last_evidence FROM (SELECT *, bool_and(one) OVER (PARTITION BY user_id, k, seg) AS last2 FROM m) GROUP BY 1, 2, 3")
def graph_store_relations(spark, d):
    """Relations over the same batches: the last evidence is that of the later batch's last memory."""
    r = _graph(spark, d).relations.read()
    return r.select("user_id", "source", "target", F.round("weight", 6).alias("weight"), "evidence_count", F.col("last_evidence").cast("timestamp_ntz").alias("last_evidence"))


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders")
def backfill_resumed(spark, d):
    """All orders in pages of their key: stopped after two pages, taken up by another writer, and finished."""
    job = Backfill(spark, _base(spark, "backfill"), "o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))
    page = max(1, rows.count() // 6)
    job.run(rows, page, stop_after=2)
    job.run(rows, page)
    if not job.complete():
        raise RuntimeError("pages are missing")
    return job.read()


_BELOW = (f"WITH RECURSIVE {MEM}, asked AS (SELECT doc_id AS root, lang AS user_id FROM documents WHERE doc_id % 20 = 1), "
          "below AS (SELECT a.root, a.user_id, m.id, 1 AS depth FROM asked a JOIN mem m ON m.parent_id = a.root AND m.user_id = a.user_id UNION ALL SELECT b.root, b.user_id, m.id, depth + 1 FROM below b JOIN mem m ON m.parent_id = b.id AND m.user_id = b.user_id)")


def _roots(spark, d):
    return table(spark, d, "documents").filter("doc_id % 20 = 1").selectExpr("doc_id as root", "lang as user_id")


@query(_BELOW + " SELECT root, id, depth::BIGINT AS depth FROM below WHERE root <> id")
def closures_of_roots(spark, d):
    """What stands below each memory whose id leaves 1 divided by 20, all roots in one walk."""
    return C.closures(memories(spark, d), _roots(spark, d)).select("root", "id", "depth")


_PLANS = _BELOW + """, s AS (SELECT a.root, a.user_id, count(b.id) AS closure, coalesce(max(depth), 0) AS depth FROM asked a LEFT JOIN below b ON b.root = a.root AND b.user_id = a.user_id GROUP BY 1, 2),
cl AS (SELECT root, user_id, root AS id FROM s WHERE closure <= 3 UNION SELECT b.root, b.user_id, b.id FROM below b JOIN s ON s.root = b.root AND s.user_id = b.user_id WHERE closure <= 3),
src AS (SELECT user_id, id AS d, unnest(derived_from) AS id FROM mem),
dep AS (SELECT DISTINCT cl.root, cl.user_id, d AS id FROM src JOIN cl ON cl.id = src.id AND cl.user_id = src.user_id WHERE NOT EXISTS (SELECT 1 FROM cl c WHERE c.root = cl.root AND c.id = d))"""


@query(_PLANS + " SELECT s.root, CASE WHEN closure > 3 THEN 'refused' ELSE 'planned' END AS status, closure, depth::BIGINT AS depth, (SELECT count(*) FROM dep WHERE dep.root = s.root) AS derived FROM s")
def erase_many_receipts(spark, d):
    """Receipts of erasing all those roots; closures above three memories are refused, root by root."""
    return C.erase_many(memories(spark, d), _roots(spark, d), most=3)[1].select("root", "status", "closure", "depth", "derived")


@query(_PLANS + ", gone AS (SELECT DISTINCT user_id, id FROM cl UNION SELECT DISTINCT user_id, id FROM dep), stay AS (SELECT * FROM mem m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = m.id AND g.user_id = m.user_id)), p AS (SELECT root, user_id, id FROM cl UNION SELECT root, user_id, id FROM dep) SELECT p.root, 0 AS rows, (SELECT count(*) FROM stay WHERE parent_id IN (SELECT id FROM p q WHERE q.root = p.root)) AS children FROM p GROUP BY p.root")
def erase_many_residuals(spark, d):
    """The check after the erase: rows that should be gone, and children left without their parent."""
    m = memories(spark, d)
    plan, _ = C.erase_many(m, _roots(spark, d), most=3)
    return C.erase_residuals(C.apply_erase(m, plan), plan).select("root", "rows", "children")


@query("SELECT conv_id || '-' || turn AS item_id, TIMESTAMP '2024-01-01' + to_hours((turn % 40)::INTEGER) AS sent, role AS sender, 'Turn ' || turn AS title, trim(x, E' \\t\\n\\r') AS text FROM (SELECT *, replace(text, chr(10), ' ') AS x FROM conversations) WHERE turn % 40 >= 3")
def spool_mails(spark, d):
    """All turns as mails of a spool, read as a data source; the lower bound of the date is pushed into it."""
    spools.register(spark)
    base = _base(spark, "spool")
    _as_mails(table(spark, d, "conversations")).write.text(base)
    got = spark.read.format("spool").option("path", base).option("kind", "mail").load().filter("sent >= timestamp'2024-01-01 03:00:00'")
    return got.select("item_id", F.col("sent").cast("timestamp_ntz").alias("sent"), "sender", "title", "text")


def _as_mails(turns):
    head = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    at = F.expr("date_format(timestampadd(HOUR, turn % 40, timestamp'2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    body = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(F.expr("translate(base64(encode(replace(text, char(10), ' '), 'UTF-8')), concat('+/=', char(13), char(10)), '-_')").alias("data")).alias("body"))
    payload = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(head("Date", at), head("From", F.col("role")), head("Subject", F.concat(F.lit("Turn "), F.col("turn").cast("string")))).alias("headers"), F.array(body).alias("parts"))
    return turns.select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), payload.alias("payload"))).alias("value"))


@query("SELECT source AS sender, count(*) AS items, sum(length(lang) + length('Doc ' || doc_id)) AS letters FROM documents GROUP BY 1")
def spool_feed_stream(spark, d):
    """Documents as feed entries, laid into the spool in two legs; the stream's cursor goes over the restart."""
    spools.register(spark)
    base = _base(spark, "feed")
    docs = table(spark, d, "documents")
    line = F.concat(F.lit("<item><guid>"), F.col("doc_id").cast("string"), F.lit("</guid><author>"), F.col("source"), F.lit("</author><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><title>Doc "), F.col("doc_id").cast("string"), F.lit("</title><description>&lt;b&gt;"), F.col("lang"), F.lit("&lt;/b&gt;</description></item>"))
    for leg in (0, 1):
        docs.filter(F.col("doc_id") % 2 == leg).select(line.alias("value")).write.mode("append").text(f"{base}/in")
        run_to_end(spark.readStream.format("spool").option("path", f"{base}/in").option("kind", "feed").load(), f"{base}/check", f"{base}/out")
    got = spark.read.schema(spools.SCHEMA).parquet(f"{base}/out")
    return got.groupBy("sender").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("title") + F.length("text")).alias("letters"))


@query("SELECT role, count(*) AS lines FROM conversations GROUP BY 1")
def captured_lines(spark, d):
    """Turns as files of a folder, captured in three triggers: half of them, the other half, and all files touched only."""
    base = _base(spark, "capture")
    line = table(spark, d, "conversations").select("conv_id", F.concat("role", F.lit("|"), F.col("turn").cast("string")).alias("value"))
    run = lambda: run_to_end(captured_files(spark, f"{base}/in"), f"{base}/check", f"{base}/out")
    with settings(spark, **_STATE):
        for leg in (0, 1):
            line.filter(F.col("conv_id") % 2 == leg).select("value").write.mode("append").text(f"{base}/in")
            run()
        folder = Folder(spark, f"{base}/in")
        for name in folder.names():
            folder.touch(name)
        run()
    got = spark.read.schema("path string, mtime long, sha16 string, change string, text string").parquet(f"{base}/out")
    return got.select(F.explode(F.split("text", "\n")).alias("l")).filter("l <> ''").groupBy(F.split("l", r"\|")[0].alias("role")).agg(F.count(F.lit(1)).alias("lines"))


@query("""WITH t AS (SELECT vec_id, range(0, 8).list_transform(lambda i: embedding[8 * i + 1 : 8 * i + 8]::DOUBLE[]) AS tok, range(0, 8).list_transform(lambda i: (i <= vec_id % 9 - 1)::INT) AS mask FROM embeddings),
p AS (SELECT vec_id, tok[1] AS c, range(1, 9).list_transform(lambda j: list_sum(range(1, 9).list_transform(lambda i: tok[i][j] * mask[i])) / greatest(list_sum(mask), 1)) AS m FROM t),
n AS (SELECT vec_id, c, m, greatest(sqrt(list_sum(c.list_transform(lambda x: x * x))), 1e-12) AS nc, greatest(sqrt(list_sum(m.list_transform(lambda x: x * x))), 1e-12) AS nm FROM p),
u AS (SELECT *, unnest(range(1, 9)) AS j FROM n) SELECT vec_id, (j - 1)::INT AS dim, round(c[j] / nc, 6) AS cls, round(m[j] / nm, 6) AS mean FROM u""")
def pooled_tokens(spark, d):
    """An embedding as eight token vectors of eight; the mask leaves out the last ones, for some rows all."""
    t = table(spark, d, "embeddings").select("vec_id", F.expr("transform(sequence(0, 7), i -> slice(embedding, 8 * i + 1, 8))").alias("tok"), F.expr("transform(sequence(0, 7), i -> if(i <= vec_id % 9 - 1, 1, 0))").alias("mask"))
    pooled = t.select("vec_id", S.cls_pool(F.col("tok")).alias("c"), S.mean_pool(F.col("tok"), F.col("mask")).alias("m"))
    return pooled.select("vec_id", F.posexplode(F.arrays_zip("c", "m")).alias("dim", "v")).select("vec_id", "dim", F.round("v.c", 6).alias("cls"), F.round("v.m", 6).alias("mean"))
