"""Operators compared by all that they give: outcomes of a sync, reports, titles, whole mails, edge cases of imports."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from recallium.functions import text as T
from recallium.operators import analytics as A
from recallium.operators import relational as J
from recallium.plans.adapters import GRAPH, NOW, graph, table
from recallium.plans.catalog import query
from recallium.session import shared_dir
from recallium.sources import benchmarks as B
from recallium.sources import connectors as C
from recallium.sources import importers as I
from recallium.sources.source_store import SourceStore
from recallium.streaming.replay import in_legs, in_time_slices, run_to_end
from recallium.streaming.streams import distinct_within


def _base(spark, name):
    return f"{shared_dir(spark)}/recallium/{name}-{uuid.uuid4().hex}"


_SYNC = """i AS (SELECT doc_id AS pos, lang AS source_id, 'r' || doc_id // 3 AS item_ref, 'T' || doc_id % 2 AS title, doc_id % 5 = 0 AS later FROM documents),
live AS (SELECT * FROM i WHERE item_ref NOT IN (SELECT 'r' || doc_id FROM labels WHERE toxic = 1)),
w AS (SELECT *, lag(title) OVER (PARTITION BY source_id, item_ref ORDER BY later, pos) AS before FROM live),
a AS (SELECT *, CASE WHEN before IS NULL THEN 'added' WHEN before = title THEN 'skipped' ELSE 'updated' END AS action FROM w)"""


def _synced(spark, d):
    docs = table(spark, d, "documents")
    items = docs.selectExpr("doc_id as pos", "lang as source_id", "concat('r', doc_id div 3) as item_ref", "concat('T', doc_id % 2) as title", "'same' as content", "cast(null as string) as summary", "'u' as url", "cast(null as timestamp) as captured_at", "doc_id % 5 = 0 as later")
    gone = table(spark, d, "labels").filter("toxic = 1").selectExpr("concat('r', doc_id) as item_ref").crossJoin(F.broadcast(docs.select(F.col("lang").alias("source_id")).distinct()))
    store = SourceStore(spark, _base(spark, "sources"), 4)
    first = store.sync(items.filter("not later"), gone, 0)
    again = store.sync(items.filter("later"), gone, 1)
    store.sync(items.filter("later"), gone, 1)  # delivered again
    return store, first.unionByName(again)


@query(f"WITH {_SYNC} SELECT pos, action FROM a UNION ALL SELECT pos, 'skipped' FROM i WHERE item_ref NOT IN (SELECT item_ref FROM live)")
def source_sync_actions(spark, d):
    """Two fetches of each source, the second delivered twice; a reference that a fetch repeats is updated where it differs."""
    return _synced(spark, d)[1].select("pos", "action")


@query(f"WITH {_SYNC} SELECT source_id, item_ref, arg_max(title, (later, pos)) FILTER (action <> 'skipped') AS title, count(*) FILTER (action <> 'skipped') AS revision FROM a GROUP BY 1, 2")
def source_sync_rows(spark, d):
    """What the store holds after both fetches."""
    return _synced(spark, d)[0].read().select("source_id", "item_ref", "title", "revision")


@query("SELECT host, url FROM (SELECT DISTINCT regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host, url FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY url) <= 100")
def url_list_items(spark, d):
    """The addresses themselves, the first hundred of each host; no host's list is gathered before it is cut."""
    p = table(spark, d, "pages").select(C.page_host(F.col("url")).alias("host"), "url").distinct()
    return p.withColumn("_n", F.expr("row_number() over (partition by host order by url)")).filter("_n <= 100").drop("_n")


@query("SELECT doc_id::VARCHAR AS source_ref, left(trim('[' || lang || '] ' || left(trim(text, ' '), 120), ' ' || chr(9) || chr(10) || chr(13)), 500) AS title FROM documents")
def import_pam_titles(spark, d):
    """The operator's own titles."""
    f = table(spark, d, "documents").selectExpr("""concat('{"schema":"portable-ai-memory","memories":[', to_json(named_struct('id', cast(doc_id as string), 'type', lang, 'content', text, 'provenance', 'text')), ']}') as value""")
    return I.parse_export(f, "pam", F.lit(NOW)).select("source_ref", "title")


@query(r"""SELECT conv_id::VARCHAR AS source_ref, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || t || chr(10) || 'end', chr(10) || chr(10) ORDER BY turn) AS content FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations) WHERE role IN ('user', 'assistant') AND t <> '' GROUP BY 1 HAVING length(content) <= 10000""")
def import_chatgpt_parts(spark, d):
    """Exports whose messages also hold images, numbers, lists and nulls: strings only are text."""
    c = table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant") & F.rlike("text", F.lit(r"\S")))
    node = F.expr("""concat('"', turn, '":{"message":{"author":{"role":"', role, '"},"create_time":', turn + 1, ',"content":{"parts":[{"asset_pointer":"file://', turn, '"},', substring(to_json(array(text)), 2, length(to_json(array(text))) - 2), ',7,null,true,["no"]," ","end"]}}}')""")
    picture = F.lit('"p":{"message":{"author":{"role":"user"},"create_time":0,"content":{"parts":[{"asset_pointer":"file://x"}]}}}')
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))), lambda x: x["n"]), ",").alias("m"))
    f = files.select(F.concat(F.lit('[{"id":"'), F.col("conv_id").cast("string"), F.lit('","create_time":1,"mapping":{'), picture, F.lit(","), "m", F.lit('}},{"id":"only a picture","create_time":1,"mapping":{'), picture, F.lit("}}]")).alias("value"))
    return I.parse_export(f, "chatgpt", F.lit(NOW)).select("source_ref", "content").filter(~F.endswith("content", F.lit("[import truncated]")))


@query(r"SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents")
def mail_texts_whole(spark, d):
    """Whole texts of any length through a mail's transfer coding."""
    b64 = "translate(base64(encode(text, 'UTF-8')), concat('+/=', char(13), char(10)), '-_')"
    rows = table(spark, d, "documents").selectExpr("doc_id", f"""concat('{{"mimeType":"multipart/mixed","parts":[{{"mimeType":"text/plain","body":{{"data":"', {b64}, '"}}}},{{"mimeType":"text/html","body":{{"data":"PGI-bm88L2I-"}}}}]}}') as payload""")
    return C.mails(rows).select("doc_id", "text")


@query("""WITH c AS (SELECT doc_id AS id, lang AS category, quality = 1 AS passed, doc_id % 3 / 2.0::DOUBLE AS sh, quality::DOUBLE AS kc, doc_id % 4 = 0 AS cit, (doc_id % 2)::DOUBLE AS fb, doc_id % 8 AS ms, CASE WHEN doc_id % 5 = 0 THEN '—' ELSE source || ', b' END AS src FROM labels JOIN documents USING (doc_id))
SELECT 1 AS part, id, '| ' || CASE WHEN passed THEN '✅' ELSE '⚠️' END || ' | ' || id || ' | ' || category || ' | ' || printf('%.1f', sh * 100) || '% | ' || printf('%.1f', kc * 100) || '% | ' || CASE WHEN cit THEN 'yes' ELSE 'no' END || ' | ' || CASE WHEN fb = 1 THEN 'yes' ELSE 'no' END || ' | ' || printf('%.1f', ms::DOUBLE) || ' ms | ' || src || ' |' AS line FROM c
UNION ALL SELECT 2, id, '- ' || id || ' (' || category || ')' FROM c WHERE NOT passed
UNION ALL SELECT 0, 8 + i, '| ' || ['Total cases', 'Passed cases', 'Failed cases'][i + 1] || ' | ' || [n, ok, n - ok][i + 1] || ' |' FROM (SELECT count(*) AS n, count(*) FILTER (passed) AS ok, unnest(range(0, 3)) AS i FROM c)""")
def evaluation_report(spark, d):
    """The Markdown report over all labelled documents as cases: counts of the summary, each case's line, and the failed ones."""
    c = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    cases = c.selectExpr("doc_id as id", "lang as category", "quality = 1 as passed", "doc_id % 3 / 2.0D as source_hit", "cast(quality as double) as keyword_coverage", "doc_id % 4 = 0 as has_citation", "cast(doc_id % 2 as double) as fallback_accuracy", "false as hallucination", "false as corrected", "cast(doc_id % 8 as double) as latency_ms", "if(doc_id % 5 = 0, cast(array() as array<string>), array(source, 'b')) as sources")
    return C.evaluation_report(cases, "2024-01-30T00:00:00Z").filter("part > 0 or (id >= 8 and id <= 10)")


@query("SELECT event_id, event_type, value FROM events")
def ledger_appended(spark, d):
    """All events appended to a ledger in three batches and read again."""
    path = f"{_base(spark, 'ledger')}/entries"
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    for k in range(3):
        C.append_ledger(e.filter(F.col("event_id") % 3 == k), path)
    return spark.read.schema(e.schema).parquet(path)


@query(f"WITH {GRAPH}, linked AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 45), gone AS (SELECT p_partkey AS p FROM part WHERE p_partkey NOT IN (FROM linked)) SELECT source, target FROM edges WHERE source IN (FROM gone) OR target IN (FROM gone)")
def orphan_relations(spark, d):
    """Relations that touch an entity without a link."""
    ents = table(spark, d, "part").selectExpr("p_partkey as entity_id")
    links = table(spark, d, "lineitem").filter("l_linenumber = 1 and l_quantity >= 45").selectExpr("l_partkey as entity_id")
    return J.orphans(ents, links, graph(spark, d)[1].select("source", "target"))[1]


@query("SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 45)")
def orphan_parts(spark, d):
    """Entities without a link: there are some at every size."""
    links = table(spark, d, "lineitem").filter("l_linenumber = 1 and l_quantity >= 45").selectExpr("l_partkey as entity_id")
    return J.orphans(table(spark, d, "part").selectExpr("p_partkey as entity_id"), links, graph(spark, d)[1].select("source", "target"))[0]


_WINDOW = "FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 240 HOUR"


@query(f"SELECT count(*) AS sample_size, round(count(*) FILTER (event_id % 6 = 0) / count(*) FILTER (event_id % 2 = 0), 4) AS citation_rate, round(count(*) FILTER (event_id % 5 <> 0) / count(*), 4) AS grounded_rate, round(count(*) FILTER (event_id % 7 = 0) / count(*), 4) AS self_correction_rate, round(avg(event_id % 100), 2) AS avg_answer_latency_ms {_WINDOW}")
def quality_window_rates(spark, d):
    """The rates of the last ten days' answers."""
    trace = """concat('{"citation":{"required":', event_id % 2 = 0, ',"has_citation":', event_id % 3 = 0, '},"hallucination":{"grounded":', event_id % 5 <> 0, '},"correction":[', if(event_id % 7 = 0, '1', ''), '],"answer":{"latency_ms":', event_id % 100, '}}') as trace"""
    e = table(spark, d, "events").selectExpr("if(event_type = 'view', 'user', 'assistant') as role", "ts as created_at", trace)
    return A.windowed_quality(e, F.lit(NOW).cast("timestamp_ntz"), 240).select("sample_size", "citation_rate", "grounded_rate", "self_correction_rate", "avg_answer_latency_ms")


@query(f"WITH {GRAPH} SELECT CASE WHEN source % 3 = 0 THEN 'related' ELSE 'kind' || source % 3 END AS relation, count(*) AS edges, round(avg(weight), 6) AS mean_weight FROM edges GROUP BY 1")
def graph_edge_types(spark, d):
    return A.edge_types(graph(spark, d)[1].withColumn("relation", F.expr("if(source % 3 = 0, null, concat('kind', source % 3))")))


def _occurrences(query: str, texts: list[str]) -> list[float]:
    """A stand-in for a caller's cross-encoder."""
    return pd.Series(texts).str.count(query).astype(float).tolist()


@query("SELECT doc_id AS id, (length(text) - length(replace(text, 'the', ''))) / 3.0::DOUBLE AS rerank_score FROM documents ORDER BY rerank_score DESC, id LIMIT 25")
def reranked_documents(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id as id", "text as content")
    return B.rerank(docs, "the", _occurrences, 25).select("id", "rerank_score")


@query("SELECT l_orderkey AS id, round(max(l_extendedprice), 2) AS relevance, max(l_shipdate) AS created FROM lineitem GROUP BY 1 ORDER BY relevance DESC, created DESC, id LIMIT 20 OFFSET 5")
def insight_list(spark, d):
    """Insights by relevance, newest first among equals."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.max("l_extendedprice"), 2).alias("relevance"), F.max("l_shipdate").alias("created"))
    return rows.orderBy(F.desc("relevance"), F.desc("created"), "id").offset(5).limit(20)


@query("SELECT doc_id, sha256(length(lang)::VARCHAR || ':' || lang || length(source)::VARCHAR || ':' || source || length(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR) AS key FROM documents")
def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cache_key_of(F.col("lang"), F.col("source"), F.col("doc_id")).alias("key"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def ttl_distinct_stream(spark, d):
    """Each (user, type) is let through once in sixty days; the stream has three legs, with restarts between."""
    base = _base(spark, "ttl")
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    in_legs(spark, in_time_slices(e, "ts", 3), base, lambda s: run_to_end(distinct_within(s, ["user_id", "event_type"], "60 days").select("user_id", "event_type"), f"{base}/check", f"{base}/out"))
    return spark.read.schema("user_id long, event_type string").parquet(f"{base}/out")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || chr(10) || '[... truncated: file exceeds 5MB]' ELSE text END AS text FROM documents")
def capped_files(spark, d):
    """File texts cut with a mark, at a cap of 500 characters so that there are some."""
    return table(spark, d, "documents").select("doc_id", C.capped_file_text(F.encode("text", "UTF-8"), 500).alias("text"))
