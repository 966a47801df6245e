"""Importers and connectors over conversations, pages, events and orders."""

from __future__ import annotations


from pyspark.sql import functions as F

from recallium.functions.text import to_utc
from recallium.operators.chunking import chunk_documents
from recallium.plans.adapters import table
from recallium.plans.catalog import query
from recallium.sources import connectors as C
from recallium.sources import importers as I



def _now():
    return F.expr("TIMESTAMP'2024-01-30 00:00:00'")


_LINES = "l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || trim(text, ' ') AS line FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ') <> ''), c AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS x FROM l GROUP BY 1)"
_CAP = "CASE WHEN length(x) > 10000 THEN left(x, 9980) || chr(10) || chr(10) || '[import truncated]' ELSE x END AS content"
_PRE = "CASE WHEN length(x) > 10000 THEN left(x, 9980) || chr(10) || chr(10) || '[import truncated]' ELSE x END AS content"


def _turns(spark, d, entry):
    """One array of JSON entries per conversation, in order of turn."""
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"to_json({entry}) as e")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "e"))).alias("l")).select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]")).alias("a"), F.col("l").alias("l"))


def _files(rows, element):
    """Each conversation as a file of one element."""
    return rows.select(F.concat(F.lit("["), element, F.lit("]")).alias("value"))


@query(f"WITH {_LINES} SELECT conv_id::VARCHAR AS source_ref, {_CAP} FROM c")
def import_chatgpt(spark, d):
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", "concat('\"n', 1000 - turn, '\":', to_json(named_struct('message', named_struct('author', named_struct('role', role), 'create_time', turn + 1.5D, 'content', named_struct('parts', array(text, null)))))) as e")
    m = c.groupBy("conv_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("t"), "e"))), lambda x: x["e"]), ","), F.lit("}")).alias("m"))
    f = _files(m, F.concat(F.lit('{"id":"'), F.col("conv_id"), F.lit('","title":"t","create_time":1704067200.5,"mapping":'), F.col("m"), F.lit("}")))
    return I.parse_export(f, "chatgpt", _now()).select("source_ref", "content")


@query(f"WITH {_LINES} SELECT conv_id::VARCHAR AS source_ref, 'Untitled Claude conversation' AS title, {_CAP} FROM c")
def import_claude(spark, d):
    t = _turns(spark, d, "named_struct('sender', case role when 'user' then 'human' else role end, 'text', text)")
    f = _files(t, F.concat(F.lit('{"uuid":"'), F.col("conv_id"), F.lit('","created_at":"2024-01-02T03:04:05Z","chat_messages":'), F.col("a"), F.lit("}")))
    return I.parse_export(f, "claude", _now()).select("source_ref", "title", "content")


_ALL = "l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || trim(text, ' ') AS line FROM conversations WHERE trim(text, ' ') <> ''), c AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS x FROM l GROUP BY 1)"


@query(f"WITH {_ALL} SELECT 'G' || conv_id AS source_ref, 'G' || conv_id AS title, {_PRE} FROM c")
def import_gemini(spark, d):
    t = _turns(spark, d, "named_struct('role', role, 'text', text)")
    f = t.select(F.concat(F.lit('{"conversations":[{"title":"G'), F.col("conv_id"), F.lit('","messages":'), F.col("a"), F.lit("}]}")).alias("value"))
    return I.parse_export(f, "gemini", _now()).select("source_ref", "title", "content")


@query(f"WITH {_ALL} SELECT conv_id::VARCHAR AS source_ref, {_PRE} FROM c")
def import_copilot(spark, d):
    t = _turns(spark, d, "named_struct('role', role, 'content', text)")
    f = _files(t, F.concat(F.lit('{"conversation_id":"'), F.col("conv_id"), F.lit('","thread":'), F.col("a"), F.lit("}")))
    return I.parse_export(f, "copilot", _now()).select("source_ref", "content")


@query(f"WITH {_ALL} SELECT 's' || conv_id AS source_ref, 'OpenClaw session s' || conv_id AS title, {_PRE} FROM c")
def import_openclaw(spark, d):
    t = _turns(spark, d, "named_struct('role', role, 'content', text)")
    f = t.select(F.concat(F.lit('{"memory_entries":[{"session_id":"s'), F.col("conv_id"), F.lit('","entries":'), F.col("a"), F.lit("}]}")).alias("value"))
    return I.parse_export(f, "openclaw", _now()).select("source_ref", "title", "content")


@query("SELECT doc_id::VARCHAR AS source_ref, 'u' || doc_id AS source_url, [lang, source] AS tags, CASE WHEN length(x) > 10000 THEN left(x, 9980) || chr(10) || chr(10) || '[import truncated]' ELSE x END AS content FROM (SELECT *, trim(text, ' ') AS x FROM documents)")
def import_generic(spark, d):
    f = table(spark, d, "documents").selectExpr("concat('[', to_json(named_struct('content', text, 'ref', cast(doc_id as string), 'url', concat('u', doc_id), 'tags', array(lang, '', source))), ',7]') as value")
    return I.parse_export(f, "generic", _now()).select("source_ref", "source_url", "tags", "content")


@query("SELECT doc_id::VARCHAR AS source_ref, '[' || lang || '] ' || left(trim(text, ' '), 120) AS title, [lang] AS tags FROM documents")
def import_pam(spark, d):
    f = table(spark, d, "documents").selectExpr("""concat('{"schema":"portable-ai-memory","memories":[', to_json(named_struct('id', cast(doc_id as string), 'type', lang, 'content', text, 'provenance', 'text')), ']}') as value""")
    out = I.parse_export(f, "pam", _now())
    return out.select("source_ref", F.concat(F.lit("["), F.col("tags")[0], F.lit("] "), F.left("content", F.lit(120))).alias("title"), "tags")


@query("SELECT role, count(*) AS n, CASE role WHEN 'user' THEN 'chatgpt' WHEN 'assistant' THEN 'claude' ELSE 'unknown' END AS format FROM conversations GROUP BY 1")
def import_detect(spark, d):
    c = table(spark, d, "conversations").selectExpr("role", "case role when 'user' then concat('[', to_json(named_struct('mapping', text)), ']') when 'assistant' then concat('[', to_json(named_struct('chat_messages', text)), ']') else to_json(named_struct('x', text)) end as v")
    return c.select("role", I.detect_format(F.col("v")).alias("format")).groupBy("role", "format").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-30' ELSE date_trunc('second', ts) END AS at FROM events")
def import_times(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "case event_id % 3 when 0 then 'garbage' when 1 then cast(unix_seconds(cast(ts as timestamp)) as string) else date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end as s")
    return e.select("event_id", to_utc(F.col("s"), _now()).cast("timestamp_ntz").alias("at"))


@query("WITH i AS (SELECT doc_id AS pos, CASE WHEN source = 'src0' THEN NULL ELSE source || '-' || lang END AS source_ref FROM documents), s AS (SELECT DISTINCT source || '-en' AS source_ref FROM documents WHERE source IN ('src1', 'src2')) SELECT min(pos) AS pos, source_ref FROM i WHERE source_ref IS NOT NULL AND source_ref NOT IN (FROM s) GROUP BY 2 UNION ALL SELECT pos, source_ref FROM i WHERE source_ref IS NULL")
def import_dedup(spark, d):
    docs = table(spark, d, "documents")
    items = docs.selectExpr("doc_id as pos", "case when source <> 'src0' then concat(source, '-', lang) end as source_ref", "text as content")
    stored = docs.filter("source in ('src1', 'src2')").selectExpr("concat(source, '-en') as source_ref").distinct()
    return I.dedup_import(items, stored).select("pos", "source_ref")


@query("WITH i AS (SELECT doc_id AS pos, CASE WHEN source = 'src0' THEN NULL ELSE source || '-' || lang END AS r FROM documents) SELECT count(*) AS seen, count(*) FILTER (r IS NULL) + count(DISTINCT r) AS imported, count(r) - count(DISTINCT r) AS duplicates FROM i")
def import_summary(spark, d):
    items = table(spark, d, "documents").selectExpr("doc_id as pos", "case when source <> 'src0' then concat(source, '-', lang) end as source_ref", "text as content")
    return I.import_summary(items, I.dedup_import(items, items.limit(0).select("source_ref")))


@query(f"WITH {_LINES} SELECT conv_id, x AS content FROM c")
def conversation_transcripts(spark, d):
    return I.transcripts(table(spark, d, "conversations")).select("conv_id", "content")


@query(r"""SELECT page_id, replace(replace(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\s+', ' ', 'g')), '&quot;', '"'), '&amp;', '&') AS title, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host FROM pages""")
def web_clip_titles(spark, d):
    return C.web_clips(table(spark, d, "pages")).select("page_id", "title", C.page_host(F.col("url")).alias("host"))


@query()
def web_clips(spark, d):
    """Article text by the block rules; a parser has no SQL form, the tests hold it against the pages' known structure."""
    return C.web_clips(table(spark, d, "pages")).select("page_id", "title", "content")


@query("SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host, least(count(DISTINCT url), 100) AS n FROM pages GROUP BY 1")
def url_lists(spark, d):
    first = table(spark, d, "pages").select(C.page_host(F.col("url")).alias("host"), "url").distinct().withColumn("_n", F.expr("row_number() over (partition by host order by url)")).filter("_n <= 100")
    g = first.groupBy("host").agg(F.collect_set("url").alias("u"))  # 100 at most
    return g.select("host", F.size(C.clean_urls(F.concat("u", "u", F.array(F.lit("ftp://x"))))).cast("long").alias("n"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 50")
def feed_items(spark, d):
    e = table(spark, d, "events").selectExpr("event_type as feed", "ts", "event_id as entry_id")
    return C.feed_items(e, F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'"), 50).select(F.col("entry_id").alias("event_id"))


@query("SELECT max(ts) AS cursor FROM events")
def feed_cursor(spark, d):
    return C.next_cursor(table(spark, d, "events"))


@query("SELECT p_partkey, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 'export' WHEN p_type LIKE 'S%' AND p_size <= 20 THEN 'read' WHEN p_type LIKE 'S%' THEN 'too large' ELSE 'skip' END AS how FROM part")
def drive_plan(spark, d):
    p = table(spark, d, "part")
    first = p.agg(F.min("p_brand")).first()[0] or ""
    f = p.selectExpr("p_partkey", f"case when p_brand = '{first}' then 'doc' when p_type like 'S%' then 'text/plain' else 'image/png' end as mime", "p_size * 262144L as size")
    return C.drive_files(f, spark.createDataFrame([("doc", "text/plain")], "mime string, export string")).select("p_partkey", "how")


@query("SELECT doc_id, text FROM documents")
def file_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.file_text(F.encode("text", "UTF-8")).alias("text"))


@query(r"SELECT conv_id, count(*) AS turns FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\S') GROUP BY 1")
def session_log_turns(spark, d):
    c = table(spark, d, "conversations").filter("role in ('user', 'assistant')").selectExpr("conv_id", "turn", "concat('## ', initcap(role), '\n', text) as s")
    doc = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), "\n").alias("md"))
    return C.session_turns(doc, "conv_id", "md").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("SELECT doc_id AS document_id, 'document' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def document_memories(spark, d):
    docs = table(spark, d, "documents")
    passages = chunk_documents(docs).select("doc_id", "parent_index", "parent").distinct()
    out = C.document_memories(docs, passages, table(spark, d, "labels").filter("toxic = 1").select("doc_id"))
    return out.filter("kind = 'document'").select("document_id", "kind")


@query()
def document_memories_all(spark, d):
    """All rows of the operator, passages too; chunks have no SQL form, the tests hold them against a Python version."""
    docs = table(spark, d, "documents")
    passages = chunk_documents(docs).select("doc_id", "parent_index", "parent").distinct()
    return C.document_memories(docs, passages, table(spark, d, "labels").filter("toxic = 1").select("doc_id"))


@query("SELECT '| ' || s_suppkey || ' | ' || s_name || ' |' AS line FROM supplier")
def markdown_report(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return s.select(C.markdown_report(s).alias("line"))
