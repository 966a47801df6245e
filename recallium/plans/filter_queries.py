"""Filters, projections and scalars over documents as memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallium.functions import filters as L
from recallium.functions import scoring as S
from recallium.functions import text as T
from recallium.operators import analytics as A
from recallium.operators import relational as R
from recallium.plans.adapters import MEM, STATE_SQL, VISIBLE_SQL, memories, table
from recallium.plans.catalog import query


@query(f"WITH {MEM} SELECT id, salience FROM mem WHERE user_id = 'en' AND source_type IN ('src0', 'src1') AND salience >= 0.25 AND captured_at < TIMESTAMP '2024-01-20' AND coalesce(NOT pinned, true) AND list_contains(tags, 'en')")
def filter_language(spark, d):
    where = {"source_type": {"$in": ["src0", "src1"]}, "salience": {"$gte": 0.25}, "captured_at": {"$lt": "2024-01-20T00:00:00Z"}, "pinned": {"$ne": True}, "tags": {"$contains": "en"}}
    return memories(spark, d).filter(L.build_filter("en", where)).select("id", "salience")


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang = 'en' AND coalesce(NOT (CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END = 'good'), true) AND coalesce(source NOT IN ('src3'), true)")
def filter_exclusions_keep_absent(spark, d):
    m = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").selectExpr("doc_id as id", "lang as user_id", "case when quality = 1 then 'good' when quality = 0 then 'bad' end as source_type", "source")
    return m.filter(L.build_filter("en", {"source_type": {"$ne": "good"}})).filter(F.coalesce(~F.col("source").isin("src3"), F.lit(True))).select("id")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id = 3")
def filter_chunk_scope(spark, d):
    c = table(spark, d, "conversations").selectExpr("role as user_id", "conv_id as conversation_id", "turn as document_id")
    return c.filter(L.chunk_scope("user", 3)).selectExpr("conversation_id as conv_id", "document_id as turn")


@query(f"WITH {MEM} SELECT id, {STATE_SQL} AS state, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN dirty IS NOT NULL THEN 'dirty' WHEN needs_check IS NOT NULL THEN 'needs-check' ELSE 'current' END AS state_by_presence FROM mem")
def lifecycle_state(spark, d):
    return memories(spark, d).select("id", L.state().alias("state"), L.state_by_presence().alias("state_by_presence"))


@query(f"WITH {MEM} SELECT count(*) AS rows_all, count(*) FILTER (dirty IS NULL) AS listed, count(*) FILTER ({VISIBLE_SQL}) AS recalled FROM mem")
def visibility(spark, d):
    return memories(spark, d).agg(F.count(F.lit(1)).alias("rows_all"), F.count_if(L.not_dirty()).alias("listed"), F.count_if(L.current_only()).alias("recalled"))


@query(f"WITH {MEM} SELECT id, title, salience, count(*) OVER () AS total FROM mem WHERE user_id = 'en' AND dirty IS NULL AND source_type = 'src2' AND (title ILIKE '%th_n%' OR content ILIKE '%th_n%') ORDER BY salience DESC NULLS LAST, id LIMIT 20 OFFSET 5")
def list_memories(spark, d):
    rows = memories(spark, d).filter((F.col("user_id") == "en") & L.not_dirty() & L.list_filter(source_type="src2", q="th_n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*L.sort_keys("salience")).offset(5).limit(20).join(F.broadcast(total)).select("id", "title", "salience", "total")


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN rtrim(left(text, 160), ' ') || '…' ELSE text END AS snippet FROM documents")
def index_row_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", L.snippet(F.col("text")).alias("snippet"))


@query(f"WITH {MEM} SELECT id, title, source_type, source_ref, revision, {STATE_SQL} AS state FROM mem WHERE user_id = 'en' AND id = 6")
def memory_by_id(spark, d):
    return memories(spark, d).filter((F.col("user_id") == "en") & (F.col("id") == 6)).select("id", "title", "source_type", "source_ref", "revision", L.state().alias("state"))


@query(f"WITH {MEM} SELECT id, sha256('Title: ' || title || chr(10) || content) AS h FROM mem")
def embedded_document_text(spark, d):
    return memories(spark, d).select("id", F.sha2(L.document_text(F.col("title"), F.col("content")), 256).alias("h"))


@query(f"WITH {MEM}, b AS (SELECT id, title, captured_at, replace(content, chr(10), ' ') AS body FROM mem) SELECT id, strftime(captured_at, '%Y-%m-%d') || ' ' || title || ': ' || CASE WHEN length(body) > 120 THEN left(body, 120) || '...' ELSE body END AS line FROM b")
def context_lines(spark, d):
    return memories(spark, d).select("id", L.context_line(F.col("captured_at"), F.col("title"), F.col("content")).alias("line"))


@query("SELECT user_id, count(*) AS shown FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY 1, 2) WHERE n < 30 AND last < TIMESTAMP '2024-01-30' GROUP BY 1")
def hint_availability(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return e.filter((F.col("n") < 30) & (F.col("last") < F.expr("TIMESTAMP_NTZ'2024-01-30 00:00:00'"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("shown"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2000-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 5")
def stuck_documents(spark, d):
    return A.stuck_rows(table(spark, d, "orders"), ["P"], F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'"), 5, "o_orderstatus", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1")
def ingestion_status_counts(spark, d):
    return A.status_counts(table(spark, d, "orders"), ["F", "O", "P", "X"], "o_orderstatus")


@query(f"WITH {MEM} SELECT id FROM mem WHERE pinned AND id = 22")
def public_share(spark, d):
    return memories(spark, d).filter("pinned and id = 22").select("id")


@query(f"WITH {MEM} SELECT id, lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(attribute, '\\s+', ' ', 'g'))) || '|' || CASE WHEN scope = '' THEN 'default' ELSE lower(scope) END AS slot FROM mem")
def slot_keys(spark, d):
    return memories(spark, d).select("id", T.slot_key(F.col("subject"), F.col("attribute"), F.col("scope")).alias("slot"))


@query(r"SELECT p_partkey, left(trim(regexp_replace(p_name, '\s+', ' ', 'g')), 255) AS name, CASE WHEN replace(lower(trim(p_brand)), ' ', '_') IN ('project', 'topic') THEN replace(lower(trim(p_brand)), ' ', '_') ELSE 'other' END AS kind FROM part")
def entity_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.entity_name(F.col("p_name")).alias("name"), T.vocabulary(F.col("p_brand"), ("project", "topic"), "other").alias("kind"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\b(?:20\d{2}[-/][01]?\d[-/][0-3]?\d|[0-3]?\d[-/][01]?\d[-/]20\d{2})\b')) AS n FROM documents")
def date_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.dates(F.col("text"))).alias("n"))


@query("SELECT doc_id, list_has_any(regexp_extract_all(text, '[a-zA-Zà-ỹÀ-Ỹ]+'), ['it', 'its', 'this', 'that', 'these', 'those', 'he', 'him', 'his', 'she', 'her', 'they', 'them', 'their', 'nó', 'chúng', 'đó']) AS needs FROM documents")
def pronoun_test(spark, d):
    return table(spark, d, "documents").select("doc_id", F.arrays_overlap(F.regexp_extract_all(F.col("text"), F.lit("[a-zA-Zà-ỹÀ-Ỹ]+"), F.lit(0)), F.array(*map(F.lit, T.PRONOUNS))).alias("needs"))


@query("SELECT c_custkey, CASE WHEN h <= 70 THEN 'control' ELSE 'treatment' END AS variant FROM (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, [(strpos('0123456789abcdef', x) - 1)::BIGINT FOR x IN string_split(sha256(c_custkey || ':exp1'), '')]), lambda r, v: (r * 16 + v) % 100) AS h FROM customer)")
def experiment_bucket(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.variant_of(F.col("c_custkey"), F.lit("exp1"), [("control", 70), ("treatment", 30)]).alias("variant"))


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS DOUBLE) AS k, least(greatest(coalesce(TRY_CAST(props->>'$.k' AS DOUBLE) / 100, 0.5), 0.1), 0.9) AS share FROM events")
def json_salvage(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object(T.llm_json(F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```"))), "$.k").alias("k"))
    return e.select("event_id", F.col("k").try_cast("double").alias("k"), T.coerce_float(F.col("k").try_cast("double") / 100, 0.5, 0.1, 0.9).alias("share"))


@query(r"SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(trim(regexp_replace(lower(documents.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(benchmark.text), '\s+', ' ', 'g')))")
def benchmark_containment(spark, d):
    """Documents that contain a benchmark item, at any place."""
    b = table(spark, d, "benchmark").select("item_id", T.normalise(F.col("text")).alias("b"))
    t = table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("t"))
    return R.contained_items(t, b, "doc_id", "t", "item_id", "b")


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\[source\s*\d+\]|\(source:\s*[^)]+\)|source\s*:\s*\S+') AS cited FROM documents")
def citation_check(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_citation(F.col("text")).alias("cited"))


@query("SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END) / 3.0::DOUBLE AS coverage FROM documents")
def keyword_coverage(spark, d):
    return table(spark, d, "documents").select("doc_id", T.keyword_coverage(F.col("text"), F.array(F.lit("The"), F.lit("und"), F.lit("que"))).alias("coverage"))


@query(r"SELECT doc_id, contains(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_]', ' ', 'g') || ' ', ' moron ') AS hit FROM documents")
def answer_word_match(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_match(F.col("text"), F.lit("moron")).alias("hit"))


@query("SELECT event_id, make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 0.0) AS at FROM events")
def benchmark_dates(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy/MM/dd (EEE) HH:mm").alias("s"))
    return e.select("event_id", T.benchmark_date(F.col("s")).cast("timestamp_ntz").alias("at"))


@query("SELECT c_nationkey AS k, list_slice(list_distinct_ordered, 1, 20) AS aliases FROM (SELECT c_nationkey, list(seg ORDER BY m) AS list_distinct_ordered FROM (SELECT c_nationkey, c_mktsegment AS seg, min(c_custkey) AS m FROM customer GROUP BY 1, 2) GROUP BY 1)")
def alias_merge(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("m"))
    l = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "c_mktsegment"))), lambda x: x["c_mktsegment"]).alias("l"))  # at most a segment's number
    return l.select("k", T.merge_aliases(F.slice("l", 1, 3), F.col("l")).alias("aliases"))


@query("SELECT doc_id, length(text) >= 2000 AS tried, CASE WHEN length(text) >= 2000 THEN length(text) - 1 ELSE length(text) END AS n FROM documents")
def compression_gate(spark, d):
    t = F.col("text")
    short = T.accept_compression(t, F.left(t, F.length(t) - 1))
    return table(spark, d, "documents").select("doc_id", T.should_compress(True, t).alias("tried"), F.length(F.when(T.should_compress(True, t), short).otherwise(t)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, least(60 * pow(2, l_linenumber - 1), 3600) AS outbox_s, least(1.0 * pow(2, l_linenumber), 60.0) AS retry_s FROM lineitem")
def backoff_delays(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.outbox_backoff(n).alias("outbox_s"), T.retry_delay(n, F.lit(None).cast("double")).alias("retry_s"))


@query("SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN v])), 6) AS length FROM (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN embedding::DOUBLE[]])) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings)")
def vector_normalise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(S.norm(S.l2_normalise(F.col("embedding"))), 6).alias("length"))


@query("SELECT doc_id, CASE WHEN length(text) > 10000 THEN left(text, 9980) || chr(10) || chr(10) || '[import truncated]' ELSE text END AS content FROM documents")
def capped_content(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cap_content(F.col("text")).alias("content"))


@query("SELECT event_id, CASE WHEN query_type <> 'rag' OR NOT ctx OR rel OR NOT has_docs THEN 'answer' WHEN retry < 2 THEN 'retry_retrieval_for_irrelevant_context' ELSE 'record_irrelevant_context_retry_limit' END AS after_docs, CASE WHEN query_type <> 'rag' OR NOT ctx OR (NOT hall AND ans) THEN 'save' WHEN retry >= 2 THEN 'record_generation_retry_limit' WHEN hall THEN 'retry_answer_for_hallucination' ELSE 'retry_retrieval_for_unanswered_question' END AS after_gen FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'chat' ELSE 'rag' END AS query_type, event_id % 2 = 0 AS ctx, event_id % 3 = 0 AS rel, event_id % 5 <> 0 AS has_docs, event_id % 4 AS retry, event_id % 7 = 0 AS hall, event_id % 11 <> 0 AS ans FROM events)")
def retry_routing(spark, d):
    from recallium.operators.lifecycle import route_after_documents, route_after_generation

    e = table(spark, d, "events").selectExpr("event_id", "case when event_type = 'error' then 'chat' else 'rag' end as query_type", "event_id % 2 = 0 as has_context", "event_id % 3 = 0 as context_relevant", "event_id % 5 <> 0 as has_documents", "event_id % 4 as retry_count", "event_id % 7 = 0 as is_hallucination", "event_id % 11 <> 0 as answers_question")
    return e.select("event_id", route_after_documents().alias("after_docs"), route_after_generation().alias("after_gen"))
