"""Recall, BM25, fusion, context and digest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from recallium.functions import scoring as S
from recallium.operators import ranking as R
from recallium.plans.adapters import DECAY_SQL, MEM, NOW, VEC, VISIBLE_SQL, memories, query_vector, table, vectors
from recallium.plans.catalog import query

_SIM = "list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
_POOL = f"pool AS (SELECT *, {_SIM} AS score FROM vec ORDER BY score DESC, id LIMIT 30)"


@query(f"WITH {VEC}, {_POOL} SELECT id, round(score, 6) AS score, round(score * {DECAY_SQL} * (1 + least(0.3 * len(list_filter(['label0', 'e1'], lambda q: list_contains([lower(e) FOR e IN entities], q))), 1.0)), 6) AS final_score FROM pool WHERE {VISIBLE_SQL} ORDER BY final_score DESC, id LIMIT 10")
def recall_vector(spark, d):
    """The flagship: similarity, over-fetch, visibility, decay, salience, pins and entity boost."""
    out = R.recall(vectors(spark, d), query_vector(spark, d), 10, NOW, entities=["label0", "E1"])
    return out.select("id", F.round("score", 6).alias("score"), "final_score")


@query(f"WITH {VEC}, {_POOL} SELECT id, round(score * (0.925 + 0.15 * CASE WHEN salience = 0 THEN 0.5 ELSE salience END) * CASE WHEN pinned THEN 1.5 ELSE 1.0 END, 6) AS final_score FROM pool WHERE {VISIBLE_SQL} ORDER BY final_score DESC, id LIMIT 10")
def recall_reranked(spark, d):
    return R.recall(vectors(spark, d), query_vector(spark, d), 10, NOW, reranked=True).select("id", "final_score")


@query(f"WITH {VEC} SELECT id, round({_SIM}, 6) AS score, row_number() OVER (ORDER BY {_SIM} DESC, id) - 1 AS rank FROM vec WHERE user_id = 1 AND pinned = false ORDER BY score DESC, id LIMIT 15")
def vector_top_k(spark, d):
    from recallium.functions.filters import build_filter

    return R.vector_top_k(vectors(spark, d), query_vector(spark, d), 15, where=build_filter(1, {"pinned": False})).select("id", F.round("score", 6).alias("score"), "rank")


_QUERIES = [(0, "the and thion"), (1, "der die einheit"), (2, "que de la ción")]
_BM25 = r"""
WITH q(query_id, text) AS (VALUES (0, 'the and thion'), (1, 'der die einheit'), (2, 'que de la ción')),
w AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS t FROM documents),
tok AS MATERIALIZED (SELECT id, list_concat(t, [t[i] || '_' || t[i + 1] FOR i IN range(1, len(t))]) AS t FROM w),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS MATERIALIZED (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
idf AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats),
m AS MATERIALIZED (SELECT avg(idf) AS mean FROM idf),
qw AS (SELECT query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS t FROM q),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_concat(t, [t[i] || '_' || t[i + 1] FOR i IN range(1, len(t))])) AS term FROM qw) GROUP BY ALL),
s AS MATERIALIZED (SELECT query_id, id, round(sum(qtf * CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN qt USING (term) JOIN idf USING (term), stats, m GROUP BY ALL)
"""


@query(_BM25 + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s WHERE score > 0 QUALIFY rank < 10")
def bm25_search(spark, d):
    return R.bm25_search(table(spark, d, "documents"), spark.createDataFrame(_QUERIES, "query_id long, text string"), "doc_id", "text", 10)


@query(_BM25 + ", lists AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, 0 AS list FROM s WHERE query_id = 0 AND score > 0 QUALIFY rank < 50 UNION ALL (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS rank, 1 FROM documents QUALIFY rank < 50)) SELECT id, round(sum(1.0 / (60 + rank + 1)), 6) AS score, min(rank) AS best_rank FROM lists GROUP BY id")
def rank_fusion(spark, d):
    docs = table(spark, d, "documents")
    first = R.bm25_search(docs, spark.createDataFrame(_QUERIES[:1], "query_id long, text string"), "doc_id", "text", 50).select("id", "rank")
    second = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("n")).orderBy(F.desc("n"), "id").limit(50).withColumn("rank", F.expr("row_number() over (order by n desc, id) - 1")).select("id", "rank")
    return R.reciprocal_rank_fusion([first, second]).select("id", "score", "best_rank")


@query(f"WITH {MEM} SELECT id, round(0.8 * {DECAY_SQL}, 6) AS score FROM mem")
def time_decay(spark, d):
    return memories(spark, d).select("id", F.round(S.time_decay(F.lit(0.8), F.col("captured_at"), F.col("salience"), F.col("pinned"), F.lit(NOW).cast("timestamp_ntz")), 6).alias("score"))


@query(f"WITH {VEC} SELECT id, list_sort(list_filter(['e1', 'label0'], lambda q: list_contains([lower(e) FOR e IN entities], q))) AS matches, round(0.5 * (1 + least(0.3 * len(list_filter(['e1', 'label0'], lambda q: list_contains([lower(e) FOR e IN entities], q))), 1.0)), 6) AS score FROM vec")
def entity_boost(spark, d):
    asked = F.array(F.lit("LABEL0"), F.lit("e1"))
    return vectors(spark, d).select("id", S.entity_matches(F.col("entities"), asked).alias("matches"), F.round(S.entity_boost(F.lit(0.5), F.col("entities"), asked), 6).alias("score"))


@query(f"WITH {MEM}, m AS (SELECT * FROM mem WHERE user_id = 'en' AND {VISIBLE_SQL}), u AS ((SELECT id, captured_at FROM m WHERE pinned ORDER BY captured_at DESC, id LIMIT 30) UNION (SELECT id, captured_at FROM m WHERE captured_at >= TIMESTAMP '2024-01-23' ORDER BY captured_at DESC, id LIMIT 50) UNION (SELECT id, captured_at FROM m ORDER BY captured_at DESC, id LIMIT 20)) SELECT id, captured_at FROM u ORDER BY captured_at DESC, id LIMIT 30")
def personal_context(spark, d):
    return R.personal_context(memories(spark, d).filter("user_id = 'en'"), NOW).select("id", "captured_at")


@query(f"WITH {MEM} SELECT id, salience FROM mem WHERE user_id = 'de' AND {VISIBLE_SQL} ORDER BY salience DESC, captured_at DESC, id LIMIT 20")
def recall_by_salience(spark, d):
    from recallium.functions.filters import current_only

    return memories(spark, d).filter((F.col("user_id") == "de") & current_only()).orderBy(F.desc("salience"), F.desc("captured_at"), "id").limit(20).select("id", "salience")


@query(f"WITH {MEM} SELECT id, captured_at FROM mem WHERE user_id = 'fr' AND dirty IS NULL ORDER BY captured_at DESC, id DESC LIMIT 25")
def list_recent(spark, d):
    return memories(spark, d).filter("user_id = 'fr' and dirty is null").orderBy(F.desc("captured_at"), F.desc("id")).limit(25).select("id", "captured_at")


@query(f"WITH {MEM} SELECT id, round(CASE WHEN e.u IS NOT NULL THEN round(salience + 0.1 * (1 - salience), 6) ELSE salience END, 6) AS salience, recall_count + CASE WHEN e.u IS NOT NULL THEN 1 ELSE 0 END AS recall_count FROM mem LEFT JOIN (SELECT DISTINCT user_id AS u FROM events) e ON e.u = id")
def salience_bump(spark, d):
    out = R.bump(memories(spark, d), table(spark, d, "events").selectExpr("user_id as id"))
    return out.select("id", F.round("salience", 6).alias("salience"), "recall_count")


_OLD = f"{MEM}, old AS (SELECT id, salience, captured_at - to_days((id % 1300)::INTEGER) AS captured_at FROM mem)"


@query(f"WITH {_OLD}, p AS (SELECT *, coalesce(TRY_CAST('2024-' || strftime(captured_at, '%m-%d') AS DATE), DATE '2024-02-28') AS same FROM (SELECT * FROM old WHERE captured_at <= TIMESTAMP '2024-01-30' - INTERVAL 180 DAY ORDER BY salience DESC, captured_at DESC, id LIMIT 500)), a AS (SELECT *, (epoch(TIMESTAMP '2024-01-30') - epoch(captured_at)) // 86400 AS days FROM p WHERE abs(same - DATE '2024-01-30') <= 2) SELECT id, CASE WHEN days >= 365 THEN round_even(days / 365, 0)::INT || ' year' || CASE WHEN round_even(days / 365, 0)::INT <> 1 THEN 's' ELSE '' END || ' ago' ELSE greatest(1, round_even(days / 30, 0)::INT) || ' month' || CASE WHEN greatest(1, round_even(days / 30, 0)::INT) <> 1 THEN 's' ELSE '' END || ' ago' END AS age FROM a ORDER BY salience DESC, captured_at DESC, id LIMIT 5")
def on_this_day(spark, d):
    m = memories(spark, d).withColumn("captured_at", F.expr("timestampadd(DAY, -(id % 1300), captured_at)"))
    return R.on_this_day(m, NOW).select("id", "age")


@query(f"WITH {MEM}, t AS (SELECT id, unnest(tags) AS theme FROM mem WHERE captured_at >= TIMESTAMP '2024-01-10') SELECT theme, count(*) AS n FROM t GROUP BY theme ORDER BY n DESC, min(id), theme <> 'en' LIMIT 5")
def digest_themes(spark, d):
    return R.themes(memories(spark, d), datetime(2024, 1, 10))


@query(f"WITH {MEM}, a AS (SELECT id, row_number() OVER (ORDER BY salience DESC, id) - 1 AS rank FROM mem QUALIFY rank < 20), b AS (SELECT id, row_number() OVER (ORDER BY captured_at DESC, id) - 1 AS rank FROM mem QUALIFY rank < 20), u AS (SELECT id, rank, 0 AS pass FROM a UNION ALL SELECT id, rank, 1 FROM b) SELECT id, pass, rank FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass, rank) = 1 ORDER BY pass, rank, id LIMIT 30")
def stack_recall(spark, d):
    m = memories(spark, d)
    top = lambda *o: m.orderBy(*o).limit(20)
    a = top(F.desc("salience"), "id").withColumn("rank", F.expr("row_number() over (order by salience desc, id) - 1"))
    b = top(F.desc("captured_at"), "id").withColumn("rank", F.expr("row_number() over (order by captured_at desc, id) - 1"))
    return R.stack_recall(a, b, 15)


@query(r"SELECT doc_id, (CASE WHEN contains(x, 'thion') THEN 1 ELSE 0 END + CASE WHEN contains(x, 'einheit') THEN 1 ELSE 0 END) + 3 * (CASE WHEN contains(x, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(x, 'que') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS score FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x FROM documents)")
def offline_scorer(spark, d):
    return table(spark, d, "documents").select("doc_id", R.offline_score(F.col("text"), F.lit("Thion de einheit"), F.array(F.lit("The"), F.lit("que"))).alias("score"))


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10")
def entity_list(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").offset(10).limit(20).select("p_partkey", "p_size")


@query("SELECT doc_id FROM documents WHERE doc_id > 400 ORDER BY doc_id LIMIT 200")
def keyset_page(spark, d):
    return R.keyset_page(table(spark, d, "documents"), 400, 200, "doc_id").select("doc_id")


@query("SELECT round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5 FROM (SELECT query_id, max((rel AND rank <= 1)::INT) AS r1, max((rel AND rank <= 3)::INT) AS r3, max((rel AND rank <= 5)::INT) AS r5 FROM (SELECT a.vec_id AS query_id, a.label = b.label AS rel, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (0, 20, 40, 60, 80, 100, 120, 140)) GROUP BY query_id)")
def recall_at_k(spark, d):
    """Recall at k for a stated set of query rows against all rows."""
    from recallium.operators.analytics import recall_at

    near = R.vector_top_k_by_id(table(spark, d, "embeddings"), [20 * k for k in range(8)], 5, "vec_id", "embedding", "label")
    return recall_at(near.withColumn("relevant", F.col("label") == F.col("query_label")), [1, 3, 5])


@query("SELECT round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5 FROM (SELECT query_id, max((rel AND rank <= 1)::INT) AS r1, max((rel AND rank <= 3)::INT) AS r3, max((rel AND rank <= 5)::INT) AS r5 FROM (SELECT a.vec_id AS query_id, a.label = b.label AS rel, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) GROUP BY query_id)")
def recall_at_k_all(spark, d):
    """Recall at k for every row whose id is divisible by 20 against all rows."""
    from recallium.operators.analytics import recall_at

    near = R.vector_top_k_where(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 5, "vec_id", "embedding", "label")
    return recall_at(near.withColumn("relevant", F.col("label") == F.col("query_label")), [1, 3, 5])


@query("SELECT round(avg(s), 6) AS mean, round(min(s), 6) AS low, round(max(s), 6) AS high FROM (SELECT list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings)")
def cosine_summary(spark, d):
    q = F.array(*[F.lit(x) for x in query_vector(spark, d)])
    s = table(spark, d, "embeddings").select(S.cosine(F.col("embedding"), q).alias("s"))
    return s.agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.min("s"), 6).alias("low"), F.round(F.max("s"), 6).alias("high"))
