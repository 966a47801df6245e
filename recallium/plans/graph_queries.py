"""Extraction, co-mention, graph upkeep, components, closures, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallium.operators import chunking as K
from recallium.operators import graph as G
from recallium.plans.adapters import GRAPH, MEM, graph, memories, table, tasks_for
from recallium.plans.catalog import query

_DATE = r"\b(?:20\d{2}[-/][01]?\d[-/][0-3]?\d|[0-3]?\d[-/][01]?\d[-/]20\d{2})\b"


def _entities(spark, d):
    return G.extract_entities(memories(spark, d), "id", "content", "tags")


@query(rf"""WITH {MEM}, t AS (
SELECT id, tags[i] AS name, 'topic' AS type, 0.55 AS salience, i - 1 AS pos FROM (SELECT id, tags, unnest([1, 2]) AS i FROM mem)
UNION ALL SELECT id, dts[i], 'date', 0.5, 1000000 + i - 1 FROM (SELECT id, dts, unnest(range(1, len(dts) + 1)) AS i FROM (SELECT id, regexp_extract_all(content, '{_DATE}') AS dts FROM mem))),
b AS (SELECT id, type, name, salience, pos FROM t WHERE length(name) > 0 QUALIFY row_number() OVER (PARTITION BY id, lower(name), type ORDER BY salience DESC, pos) = 1)
SELECT id, name, type, salience::DOUBLE AS salience FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY salience DESC, pos) <= 12""")
def entity_extraction_tags_dates(spark, d):
    """Tags and dates, which both engines' patterns read alike; the phrases have a query of their own below."""
    m = memories(spark, d).withColumn("content", F.array_join(F.regexp_extract_all("content", F.lit(_DATE), F.lit(0)), " ; "))
    return G.extract_entities(m, "id", "content", "tags").select("id", "name", "type", "salience")


@query()
def entity_extraction(spark, d):
    """All three kinds; Unicode word boundaries have no DuckDB form, so the tests hold this against Python's ``re``."""
    return _entities(spark, d).select("id", "name", "type", "salience", "rank")


@query()
def co_mention_relations(spark, d):
    return G.co_mentions(_entities(spark, d)).select("id", "source", "target", "weight", "rank")


@query("WITH e AS (SELECT l_orderkey AS id, p_brand AS name, 0.4 + (l_linenumber % 5) / 10::DOUBLE AS salience FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT lower(name) AS key, 'product' AS type, count(DISTINCT id) AS mention_count, round(max(salience), 6) AS salience, min(id) AS first_seen, max(id) AS last_seen FROM e GROUP BY 1")
def graph_upsert_entities(spark, d):
    e = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("p_partkey = l_partkey")).selectExpr("l_orderkey as id", "p_brand as name", "'product' as type", "0.4D + (l_linenumber % 5) / 10D as salience")
    pairs = e.selectExpr("id", "name as source", "name as target", "salience as weight")
    return G.upsert_graph(e, pairs)[0].withColumn("salience", F.round("salience", 6))


@query("WITH p AS (SELECT o_custkey % 25 AS s, o_orderpriority AS t, o_totalprice / 1e6 AS w FROM orders) SELECT 'n' || s AS source, lower(t) AS target, round(max(w), 6) AS weight, count(*) AS evidence_count FROM p GROUP BY 1, 2")
def graph_upsert_relations(spark, d):
    p = table(spark, d, "orders").selectExpr("o_orderkey as id", "concat('N', o_custkey % 25) as source", "o_orderpriority as target", "o_totalprice / 1e6D as weight")
    m = p.selectExpr("id", "source as name", "'x' as type", "weight as salience")
    return G.upsert_graph(m, p)[1].withColumn("weight", F.round("weight", 6))


_COMP = f"{GRAPH.replace('nodes AS', 'RECURSIVE nodes AS', 1)}, e AS (SELECT source a, target b FROM edges WHERE weight >= 0.6 UNION SELECT target, source FROM edges WHERE weight >= 0.6), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), comp AS (SELECT node, least(node, coalesce(min(b), node)) AS comp FROM nodes LEFT JOIN reach ON a = node GROUP BY node)"


@query(f"WITH {_COMP} SELECT node, comp FROM comp")
def connected_components(spark, d):
    nodes, edges = graph(spark, d)
    return G.components(nodes, edges, 0.6)


@query(f"WITH {_COMP}, w AS (SELECT comp, sum(weight) AS w FROM edges JOIN comp ON node = source WHERE weight >= 0.6 GROUP BY 1) SELECT c.comp, count(*) AS size, round(coalesce(any_value(w), 0) + sum(mention_count) / 10, 4) AS score FROM comp c JOIN nodes USING (node) LEFT JOIN w ON w.comp = c.comp GROUP BY c.comp ORDER BY score DESC, size DESC, c.comp LIMIT 20")
def graph_clusters(spark, d):
    nodes, edges = graph(spark, d)
    return G.clusters(nodes, edges, 0.6).select("comp", "size", "score")


@query(f"WITH RECURSIVE {MEM}, below AS (SELECT id, 1 AS depth FROM mem WHERE parent_id = 1 AND user_id = 'en' UNION ALL SELECT m.id, depth + 1 FROM below JOIN mem m ON m.parent_id = below.id WHERE m.user_id = 'en') SELECT id, depth FROM below WHERE id <> 1")
def descendant_closure(spark, d):
    return G.descendants(memories(spark, d), 1, "en")[0]


_ERASED = (f"WITH RECURSIVE {MEM}, below AS (SELECT id, 1 AS depth FROM mem WHERE parent_id = 1 AND user_id = 'en' UNION ALL SELECT m.id, depth + 1 FROM below JOIN mem m ON m.parent_id = below.id WHERE m.user_id = 'en'), cl AS (SELECT id, 'root' AS why, 0 AS depth FROM mem WHERE id = 1 AND user_id = 'en' UNION ALL SELECT id, 'descendant', depth FROM below), dep AS (SELECT DISTINCT id FROM (SELECT id, unnest(derived_from) AS x FROM mem WHERE user_id = 'en') WHERE x IN (SELECT id FROM cl) AND id NOT IN (SELECT id FROM cl))")


@query(_ERASED + " FROM cl UNION ALL SELECT id, 'derived', -1 FROM dep")
def erase_plan(spark, d):
    return G.erase_plan(memories(spark, d), 1, "en")


@query(_ERASED + ", plan AS (SELECT id FROM cl UNION SELECT id FROM dep) SELECT (SELECT count(*) FROM mem WHERE parent_id IN (FROM plan) AND user_id <> 'en') AS cross_user_children, (SELECT count(*) FROM mem WHERE parent_id IN (FROM plan) AND user_id = 'en' AND id NOT IN (FROM plan)) AS children, (SELECT count(*) FROM documents WHERE doc_id = 1) AS entity_links, (SELECT count(*) FROM (SELECT DISTINCT doc_id // 2 AS e FROM documents) WHERE e NOT IN (SELECT doc_id // 2 FROM documents WHERE doc_id NOT IN (FROM plan))) AS orphan_entities")
def erase_effects(spark, d):
    m = memories(spark, d)
    links = m.selectExpr("id as memory_id", "id div 2 as entity_id")
    ents = links.select("entity_id").distinct().withColumn("user_id", F.lit("en"))
    return G.erase_effects(m, ents, links, G.erase_plan(m, 1, "en"), 1, "en")


_BRANDS = "e AS (SELECT l_orderkey AS id, lower(p_brand) AS key, 0.4 + (l_linenumber % 5) / 10::DOUBLE AS salience, l_linenumber AS n FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"WITH {_BRANDS}, o AS (SELECT id, key, max(salience) AS s FROM e WHERE n <= 2 GROUP BY 1, 2), b AS (SELECT id, key, max(salience) AS s FROM e WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2) SELECT coalesce(o.id, b.id) AS id, coalesce(o.key, b.key) AS key, round(greatest(coalesce(o.s, 0), coalesce(b.s, 0)), 6) AS salience, o.id IS NULL AS new FROM o FULL JOIN b ON o.id = b.id AND o.key = b.key")
def graph_links(spark, d):
    """The first two lines of each order are linked already; finished orders have been processed."""
    lines = table(spark, d, "lineitem")
    parts = tasks_for(lines)
    e = lines.repartition(parts, "l_partkey").join(table(spark, d, "part"), F.expr("p_partkey = l_partkey")).selectExpr("l_orderkey as id", "p_brand as name", "'product' as type", "0.4D + (l_linenumber % 5) / 10D as salience", "l_linenumber as n")
    stored = e.filter("n <= 2").groupBy("id", F.lower("name").alias("key"), "type").agg(F.max("salience").alias("salience"))
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey as id")
    return G.merge_links(stored, e.drop("n"), done, parts=parts).select("id", "key", F.round("salience", 6).alias("salience"), "new")


@query("SELECT event_type, CASE WHEN e > 0 THEN 'error' WHEN r > 0 THEN 'residual' WHEN u > 0 THEN 'unverified' ELSE 'completed' END AS status FROM (SELECT event_type, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (value > 500) AS r, count(*) FILTER (value < 0) AS u FROM events GROUP BY 1)")
def erase_receipts(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("value") > 500).alias("r"), F.count_if(F.col("value") < 0).alias("u"))
    return e.select("event_type", G.receipt_status(F.col("e"), F.col("r"), F.col("u")).alias("status"))


@query()
def document_chunks(spark, d):
    """Parent and child chunks; the splitter's recursion has no SQL form, the tests check its invariants."""
    return K.chunk_documents(table(spark, d, "documents"))


@query()
def turn_packs(spark, d):
    return K.pack_turns(table(spark, d, "conversations"), 2000).select("conv_id", "pack", F.size("turns").alias("n_turns"))


@query(r"SELECT conv_id, coalesce(left(arg_min(x, turn) FILTER (length(x) >= 24), 120), 'Conversation ' || conv_id) AS title FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS x FROM conversations) GROUP BY 1")
def session_titles(spark, d):
    return K.session_titles(table(spark, d, "conversations"))
