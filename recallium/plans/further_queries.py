"""Queries of operators whose texts, errors or findings are compared in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallium.functions import text as T
from recallium.operators import analytics as A
from recallium.operators import chunking as K
from recallium.operators import lifecycle as L
from recallium.operators import relational as J
from recallium.sources import benchmarks as B
from recallium.sources import connectors as C
from recallium.sources import importers as I

from .adapters import MEM, NOW, STATE_SQL, memories, table
from .catalog import query


@query(r"SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '^[*#\s]+', ''), '\s+$', '') AS text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn, role, text FROM conversations WHERE role IN ('user', 'assistant')) WHERE conv_id % 7 <> 0 AND regexp_matches(text, '\S') UNION ALL SELECT conv_id, 1, 'user', regexp_replace(regexp_replace(string_agg(text, chr(10) ORDER BY turn), '^\s+', ''), '\s+$', '') AS x FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 7 = 0 GROUP BY 1 HAVING regexp_matches(x, '\S')")
def session_log_texts(spark, d):
    """Logs with role headers; each seventh has none and is one turn of the user."""
    c = table(spark, d, "conversations").filter("role in ('user', 'assistant')").selectExpr("conv_id", "turn", "case when conv_id % 7 = 0 then text when turn % 2 = 0 then concat('**', initcap(role), ':** ', text) else concat('## ', if(role = 'user', 'Human', 'AI'), ': ', text) end as s")
    doc = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), "\n").alias("md"))
    return C.session_turns(doc, "conv_id", "md")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(x || chr(10) || lang, E' \\t\\n\\r') ELSE trim(lang || chr(10) || x, E' \\t\\n\\r') END AS text FROM (SELECT doc_id, lang, replace(left(text, 200), chr(10), ' ') AS x FROM documents)")
def mail_texts(spark, d):
    """Two plain parts, one of them in a nested multipart beside an HTML part, and data that cannot be decoded."""
    b64 = lambda c: f"translate(base64(encode({c}, 'UTF-8')), concat('+/=', char(13), char(10)), '-_')"
    part = lambda c, kind: f"concat('{{\"mimeType\":\"{kind}\",\"body\":{{\"data\":\"', {b64(c)}, '\"}}}}')"
    one, two = part("replace(left(text, 200), char(10), ' ')", "text/plain"), part("lang", "text/plain")
    tree = lambda a, b: "concat('{\"mimeType\":\"multipart/mixed\",\"parts\":[', " + a + ", ',{\"mimeType\":\"multipart/alternative\",\"parts\":[', " + part("'<b>no</b>'", "text/html") + ", ',', " + b + ", ']}]}')"
    rows = table(spark, d, "documents").selectExpr("doc_id", f"if(doc_id % 3 = 0, {tree(one, two)}, {tree(two, one)}) as payload")
    return C.mails(rows).select("doc_id", "text")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '[x] ' || lang || chr(10) || '  > ' || source || chr(10) WHEN 1 THEN '▸ ' || lang || chr(10) || '  > ' || source || chr(10) WHEN 2 THEN '🖼 ![' || lang || '](' || source || ')' || chr(10) ELSE '<!-- unsupported block: ' || 'odd' || ' -->' || chr(10) END AS text FROM documents")
def block_texts(spark, d):
    child = """'"_subchildren":[{"type":"quote","quote":{"rich_text":[{"plain_text":"', source, '"}]}}]'"""
    rich = """'"rich_text":[{"plain_text":"', lang, '"}]'"""
    rows = table(spark, d, "documents").selectExpr("doc_id", f"""case doc_id % 4 when 0 then concat('{{"type":"to_do","to_do":{{"checked":true,', {rich}, '}},', {child}, '}}') when 1 then concat('{{"type":"toggle","toggle":{{', {rich}, '}},', {child}, '}}')
        when 2 then concat('{{"type":"image","image":{{"external":{{"url":"', source, '"}},"caption":[{{"plain_text":"', lang, '"}}]}}}}') else '{{"type":"odd"}}' end as block""")
    return C.block_documents(rows).select("doc_id", "text")


@query("SELECT doc_id, list_has_any(regexp_extract_all(text, '[a-zA-Zà-ỹ]+'), ['it', 'its', 'this', 'that', 'these', 'those', 'he', 'him', 'his', 'she', 'her', 'they', 'them', 'their', 'nó', 'chúng', 'đó']) AS needs FROM documents")
def rewrite_test(spark, d):
    return table(spark, d, "documents").select("doc_id", T.needs_rewrite(F.col("text")).alias("needs"))


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(role || ': ' || text) AS n FROM conversations WHERE regexp_matches(text, '\S')),
f AS (SELECT conv_id, i, 0 AS pack, n AS total, n FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.total + t.n > 2000 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.total + t.n > 2000 THEN f.n + t.n ELSE f.total + t.n END, t.n FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, pack::INT AS pack, (count(*) + (pack > 0)::INT)::INT AS n_turns FROM f GROUP BY 1, pack""")
def turn_pack_sizes(spark, d):
    return K.pack_turns(table(spark, d, "conversations"), 2000).select("conv_id", "pack", F.size("turns").alias("n_turns"))


_STORE = "s AS (SELECT doc_id AS k, 1 + doc_id % 3 AS revision, 'f1' AS fingerprint, lang AS tenant, CASE WHEN doc_id % 11 = 0 THEN 'dirty' END AS reason FROM documents), i AS (SELECT doc_id + CASE WHEN doc_id % 9 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 1 + doc_id % 2 END AS revision, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE 'f1' END AS fingerprint, CASE WHEN doc_id % 13 = 0 THEN 'zz' ELSE lang END AS tenant FROM documents WHERE doc_id % 5 <> 0)"
_FOUND = _STORE + """, j AS (SELECT coalesce(s.k, i.k) AS k, s.k IS NOT NULL AS r, i.k IS NOT NULL AS p, s.revision AS sr, i.revision AS ir, s.fingerprint AS sf, i.fingerprint AS f, s.tenant AS st, i.tenant AS it, s.reason FROM s FULL JOIN i ON s.k = i.k),
found AS (SELECT k, unnest(CASE WHEN p AND ir IS NULL THEN ['malformed_id'] ELSE list_filter([CASE WHEN p AND f <> coalesce(sf, f) THEN 'unknown_fingerprint' END, CASE WHEN p AND NOT r THEN 'orphan' END, CASE WHEN p AND r AND reason IS NOT NULL THEN 'excluded_present' END, CASE WHEN p AND r AND reason IS NULL AND ir <> sr THEN 'stale' END, CASE WHEN p AND r AND reason IS NULL AND it <> st THEN 'tenant_mismatch' END, CASE WHEN r AND NOT p AND reason IS NULL THEN 'missing' END], lambda x: x IS NOT NULL) END) AS finding, st, it FROM j)"""


def _both(spark, d):
    docs = table(spark, d, "documents")
    s = docs.selectExpr("doc_id as k", "1 + doc_id % 3 as revision", "'f1' as fingerprint", "lang as tenant", "if(doc_id % 11 = 0, 'dirty', null) as reason")
    i = docs.filter("doc_id % 5 <> 0").selectExpr("doc_id + if(doc_id % 9 = 0, 1000000, 0) as k", "if(doc_id % 31 = 0, null, 1 + doc_id % 2) as revision", "if(doc_id % 10 = 0, 'xx', 'f1') as fingerprint", "if(doc_id % 13 = 0, 'zz', lang) as tenant")
    return s, i


@query(f"WITH {_FOUND} SELECT k, finding FROM found")
def audit_findings(spark, d):
    return J.audit_findings(*_both(spark, d), "k").select("k", "finding")


@query(f"WITH {_FOUND}, u AS (SELECT tenant, 1 AS total, (reason IS NULL)::INT AS eligible, 0 AS points, 0 AS missing, 0 AS stale, 0 AS orphan FROM s UNION ALL SELECT tenant, 0, 0, 1, 0, 0, 0 FROM i UNION ALL SELECT CASE WHEN finding = 'orphan' THEN it ELSE st END, 0, 0, 0, (finding = 'missing')::INT, (finding = 'stale')::INT, (finding = 'orphan')::INT FROM found) SELECT coalesce(tenant, 'unknown') AS tenant, sum(total)::BIGINT AS total, sum(eligible)::BIGINT AS eligible, sum(points)::BIGINT AS points, sum(missing)::BIGINT AS missing, sum(stale)::BIGINT AS stale, sum(orphan)::BIGINT AS orphan FROM u GROUP BY 1")
def audit_by_tenant(spark, d):
    s, i = _both(spark, d)
    return J.tenant_report(s, i, J.audit_findings(s, i, "k"))


@query("SELECT 'r' || n.doc_id AS source_ref, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN o.lang = n.lang AND o.text IS NOT DISTINCT FROM n.text AND o.doc_id % 5 <> 0 THEN 'skipped' ELSE 'updated' END AS action FROM documents n LEFT JOIN documents o ON o.doc_id = n.doc_id AND o.doc_id % 2 = 0")
def source_upsert_summaries(spark, d):
    """Every fifth stored item has another summary."""
    new = table(spark, d, "documents").selectExpr("concat('r', doc_id) as source_ref", "lang as title", "text as content", "source as summary", "doc_id")
    old = new.filter("doc_id % 2 = 0").withColumn("summary", F.expr("if(doc_id % 5 = 0, 'other', summary)"))
    return J.sync_actions(old.drop("doc_id"), new.drop("doc_id"), new.limit(0).select("source_ref")).select("source_ref", "action")


@query(f"WITH {MEM}, live AS (SELECT user_id, subject || '|' || attribute || '|' || CASE WHEN scope = '' THEN 'default' ELSE scope END AS slot, assertion FROM mem WHERE {STATE_SQL} <> 'superseded'), c AS (SELECT DISTINCT 'c' || lang || (doc_id % 40) || (doc_id % 3) AS correction_id, lang AS user_id, 'subj' || (doc_id % 40) || '|attr ' || (doc_id % 3) || '|scope1' AS slot, (doc_id % 40) % 2 = 0 AS bad FROM documents), n AS (SELECT c.*, (SELECT count(*) FROM live l WHERE l.user_id = c.user_id AND l.slot = c.slot) AS n, (SELECT count(*) FROM live l WHERE l.user_id = c.user_id AND l.slot = c.slot AND assertion <> 'fact') AS clash FROM c) SELECT correction_id, CASE WHEN n > 0 AND NOT bad THEN CASE WHEN clash = 0 THEN 'superseded' ELSE 'needs-check' END ELSE 'added' END AS status, bad OR (n > 0 AND clash > 0) AS needs_check FROM n")
def correction_times(spark, d):
    """Half of the corrections have a valid_from that is no time."""
    cor = table(spark, d, "documents").selectExpr("concat('c', lang, doc_id % 40, doc_id % 3) as correction_id", "lang as user_id", "concat('subj', doc_id % 40) as subject", "concat('attr ', doc_id % 3) as attribute", "'scope1' as scope", "'fact' as assertion", "cast(null as bigint) as target_id", "if((doc_id % 40) % 2 = 0, '2024-13-01', '2024-05-06T07:08:09Z') as valid_from").distinct()
    return L.decide_corrections(memories(spark, d), cor).select("correction_id", "status", "needs_check")


@query("SELECT count(*) AS sample_size, 48 AS window_hours FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 48 HOUR")
def quality_window(spark, d):
    e = table(spark, d, "events").selectExpr("if(event_type = 'view', 'user', 'assistant') as role", "ts as created_at", "props as trace")
    return A.windowed_quality(e, F.lit(NOW).cast("timestamp_ntz"), 48).select("sample_size", "window_hours")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity FROM lineitem ORDER BY id DESC LIMIT 50")
def cost_recent(spark, d):
    return A.recent_costs(table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_quantity"))


@query("SELECT count(*) AS n FROM events WHERE user_id = 5 AND event_type = 'click'")
def client_entries(spark, d):
    return A.entries_of_client(table(spark, d, "events"), F.lit(5), F.lit("click"), "user_id", "event_type")


@query("SELECT round(avg(CASE WHEN doc_id % 2 = 0 THEN quality END), 6) AS faithfulness, round(avg(toxic), 6) AS relevance, NULL::DOUBLE AS missing FROM labels")
def metric_means(spark, d):
    c = table(spark, d, "labels").selectExpr("if(doc_id % 2 = 0, quality, null) as faithfulness", "toxic as relevance", "cast(null as double) as missing")
    return A.metric_means(c, ["faithfulness", "relevance", "missing"])


@query("WITH s AS (SELECT user_id, event_type AS hint_id, count(*) AS shown, max(ts) AS t FROM events GROUP BY 1, 2) SELECT user_id, hint_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE hint_id WHEN 'error' THEN 0 WHEN 'click' THEN 2 ELSE 1 END, hint_id)::INT AS place FROM s WHERE hint_id <> 'signup' AND NOT (hint_id = 'view' AND t > TIMESTAMP '2024-01-25') AND NOT (hint_id IN ('click', 'error') AND shown >= CASE hint_id WHEN 'click' THEN 4 ELSE 1 END)")
def hints_in_order(spark, d):
    """Views are snoozed until their last time plus five days; clicks recur four times, errors once."""
    states = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("hint_id")).agg(F.count(F.lit(1)).alias("shown"), F.expr("if(event_type = 'view', timestampadd(DAY, 5, max(ts)), null)").alias("snoozed_until"))
    hints = spark.createDataFrame([("view", True, "medium", False, None), ("click", True, "low", True, 4), ("error", True, "high", True, None), ("signup", False, "high", False, None), ("purchase", None, "medium", False, None)], "hint_id string, active boolean, priority string, recurring boolean, max_times int")
    return A.available_hints(hints, states, F.lit(NOW).cast("timestamp_ntz")).select("user_id", "hint_id", "place")


@query("SELECT event_type AS feature, count(*) + (event_type = 'view')::INT * 7 AS n, max(ts) AS last_used FROM events GROUP BY 1")
def usage_counters(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("feature"), "ts")
    old = spark.createDataFrame([("view", 7)], "feature string, n long").withColumn("last_used", F.expr("TIMESTAMP_NTZ'2023-01-01 00:00:00'"))
    return B.usage_upsert(old, e, ["feature"])


@query(r"SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'boolean' WHEN c_custkey % 4 = 1 THEN 'integer' WHEN c_custkey % 4 = 2 THEN 'float' ELSE 'text' END AS kind FROM customer")
def answer_kinds(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "case c_custkey % 4 when 0 then ' Yes' when 1 then concat('+', c_custkey) when 2 then concat(c_custkey, '.5e3') else concat('$', c_custkey, ',200') end as a")
    return c.select("c_custkey", B.answer_kind(F.col("a")).alias("kind"))


@query("SELECT conv_id, CASE conv_id % 8 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'generic' WHEN 3 THEN 'generic' WHEN 4 THEN 'openclaw' WHEN 5 THEN 'gemini' WHEN 6 THEN 'copilot' ELSE 'unknown' END AS format FROM (SELECT DISTINCT conv_id FROM conversations)")
def import_formats(spark, d):
    shapes = ['[{"mapping":{}}]', '[{"chat_messages":[]}]', '[{"content":"x"}]', '{"schema":"portable-ai-memory","memories":[]}', '{"memory_entries":[]}', '{"memories":[],"export_version":"1"}', '{"conversations":[],"copilot_version":1}', '{"x":1}']
    return table(spark, d, "conversations").select("conv_id").distinct().withColumn("v", F.element_at(F.array(*map(F.lit, shapes)), (F.col("conv_id") % 8 + 1).cast("int"))).select("conv_id", I.detect_format(F.col("v")).alias("format"))


@query("SELECT count(*) FILTER (doc_id % 3 = 0) AS heuristic_cases, count(*) FILTER (doc_id % 3 <> 0) AS llm_cases, round(avg(quality * 0.6 + (1 - toxic) * 0.3) FILTER (doc_id % 3 <> 0), 6) AS mean_llm, round(avg((quality * 0.6 + (1 - toxic) * 0.3 >= 0.7)::INT) FILTER (doc_id % 3 <> 0), 6) AS pass_rate_llm FROM labels")
def judge_split(spark, d):
    c = table(spark, d, "labels").selectExpr("if(doc_id % 3 = 0, 'heuristic', 'model') as judged_by", "quality * 0.6D + (1 - toxic) * 0.3D as score")
    return A.judge_split(c)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'X') ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def recent_failures(spark, d):
    return A.recent_failures(table(spark, d, "orders"), ["F", "X"], 5, "o_orderstatus", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT doc_id, doc_id % 4 = 0 OR (doc_id % 4 = 1 AND contains(lower(text), 'the')) AS fell_back, CASE WHEN (doc_id % 4 = 0 OR (doc_id % 4 = 1 AND contains(lower(text), 'the'))) = (doc_id % 2 = 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy FROM documents")
def fallback_answers(spark, d):
    """Every fourth answer says that it knows nothing, in other letters and spacing; some name what is missing."""
    a = table(spark, d, "documents").selectExpr("doc_id", "case doc_id % 4 when 0 then concat(text, ' I  DON''T\nknow. ') when 1 then if(contains(lower(text), 'the'), 'Not in our manual', text) else text end as answer", "doc_id % 2 = 0 as expected")
    more = ("not in our manual",)
    return a.select("doc_id", T.is_fallback(F.col("answer"), more).alias("fell_back"), T.fallback_accuracy(F.col("expected"), F.col("answer"), more).alias("accuracy"))
