"""Test tables as memories, traces, graphs and outboxes.

Lifecycle markers, salience and times do not exist in the tables; both engines derive them from the ids by the same
expressions, kept here side by side.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int = 500_000) -> int:
    """The number of tasks for a shuffle of a stored table, by its rows (from the files' footers); the session's at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def _markers(i: str) -> list[str]:
    return [
        f"((({i} * 37) % 101) / 100D) as salience", f"{i} % 11 = 0 as pinned", f"timestampadd(SECOND, ({i} * 7919) % 2500000, TIMESTAMP_NTZ'2024-01-01 00:00:00') as captured_at",
        f"case when {i} % 17 = 0 then {i} + 1 end as superseded_by", f"case when {i} % 13 = 0 then true when {i} % 29 = 0 then false end as dirty", f"case when {i} % 19 = 0 then true end as needs_check",
        f"1 + {i} % 3 as revision", f"{i} % 5 as recall_count"]


def _markers_sql(i: str) -> str:
    return (f"(({i} * 37) % 101) / 100::DOUBLE AS salience, {i} % 11 = 0 AS pinned, TIMESTAMP '2024-01-01' + to_seconds(({i} * 7919) % 2500000) AS captured_at, "
            f"CASE WHEN {i} % 17 = 0 THEN {i} + 1 END AS superseded_by, CASE WHEN {i} % 13 = 0 THEN true WHEN {i} % 29 = 0 THEN false END AS dirty, CASE WHEN {i} % 19 = 0 THEN true END AS needs_check, "
            f"1 + {i} % 3 AS revision, {i} % 5 AS recall_count")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as id", "lang as user_id", "case when doc_id > 0 and doc_id % 4 <> 0 then doc_id div 4 end as parent_id", "concat('Memory ', doc_id) as title", "text as content", "array(lang, source) as tags",
        "lang", "source as source_type", "concat('ref', doc_id % 900) as source_ref", *_markers("doc_id"),
        "case when doc_id % 6 = 0 then array(doc_id div 2, doc_id div 3) else cast(array() as array<bigint>) end as derived_from", "concat('subj', doc_id % 40) as subject", "concat(' Attr ', doc_id % 3) as attribute",
        "case when doc_id % 4 = 0 then '' else concat('scope', doc_id % 2) end as scope", "case when doc_id % 23 = 0 then 'opinion' else 'fact' end as assertion")


MEM = ("mem AS (SELECT doc_id AS id, lang AS user_id, CASE WHEN doc_id > 0 AND doc_id % 4 <> 0 THEN doc_id // 4 END AS parent_id, 'Memory ' || doc_id AS title, text AS content, [lang, source] AS tags, lang, "
       "source AS source_type, 'ref' || (doc_id % 900) AS source_ref, " + _markers_sql("doc_id") + ", CASE WHEN doc_id % 6 = 0 THEN [doc_id // 2, doc_id // 3] ELSE [] END AS derived_from, 'subj' || (doc_id % 40) AS subject, "
       "'attr ' || (doc_id % 3) AS attribute, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'scope' || (doc_id % 2) END AS scope, CASE WHEN doc_id % 23 = 0 THEN 'opinion' ELSE 'fact' END AS assertion FROM documents)")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as memories."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "label as user_id", "embedding", "label", "array(concat('Label', label), concat('E', vec_id % 5)) as entities", *_markers("vec_id"))


VEC = ("vec AS (SELECT vec_id AS id, label AS user_id, embedding::DOUBLE[] AS embedding, label, ['Label' || label, 'E' || (vec_id % 5)] AS entities, " + _markers_sql("vec_id") + " FROM embeddings)")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0]


STATE_SQL = "CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN dirty THEN 'dirty' WHEN needs_check THEN 'needs-check' ELSE 'current' END"
VISIBLE_SQL = "superseded_by IS NULL AND dirty IS NULL"
DECAY_SQL = "(0.5 + salience) * greatest(0.1, exp(-(epoch(TIMESTAMP '2024-01-30') - epoch(captured_at)) / 86400.0 / 30.0)) * CASE WHEN pinned THEN 1.5 ELSE 1.0 END"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as nodes, parts of one order as edges: (node, name, mention_count), (source, target, weight)."""
    line = table(spark, sf_dir, "lineitem")
    nodes = table(spark, sf_dir, "part").selectExpr("p_partkey as node", "p_name as name", "p_partkey % 9 as mention_count")
    a = line.selectExpr("l_orderkey k", "l_partkey source", "l_linenumber n")
    b = line.selectExpr("l_orderkey k", "l_partkey target", "l_linenumber - 1 n")
    return nodes, a.join(b, ["k", "n"]).filter("source <> target").groupBy("source", "target").agg((F.count(F.lit(1)) / 5.0).alias("weight"))


GRAPH = ("nodes AS (SELECT p_partkey AS node, p_name AS name, p_partkey % 9 AS mention_count FROM part), "
         "edges AS (SELECT a.l_partkey AS source, b.l_partkey AS target, count(*) / 5.0::DOUBLE AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 "
         "WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)")
