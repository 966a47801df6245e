"""Ranking operators: exact vector top-k, BM25, fusion, recall, context, digest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallium.functions import scoring
from recallium.functions.filters import current_only

OVERFETCH = 3


def vector_top_k(points: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """Filtered cosine top-k with ``score`` and ``rank`` from 0, ties by id. A k of 0 or less gives no rows.

    Each task keeps its own k best, so only k rows per task are shuffled.
    """
    rows = points if where is None else points.filter(where)
    scored = rows.withColumn("score", scoring.cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])))
    top = scored.orderBy(F.desc("score"), F.asc(id_col)).limit(max(k, 0))
    return top.withColumn("rank", F.expr(f"row_number() over (order by score desc, {id_col}) - 1"))


def vector_top_k_by_id(points: DataFrame, query_ids: list[int], k: int, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """For a stated, bounded set of query rows: the k nearest other rows of each, by blocks of queries.

    Every row is scored against the broadcast block; each task keeps k candidates per query before they are ranked.
    """
    return _nearest(points, F.col(id_col).isin(query_ids), k, id_col, vector_col, label_col)


def vector_top_k_where(points: DataFrame, wanted: Column, k: int, id_col: str, vector_col: str, label_col: str | None = None, block: int = 256) -> DataFrame:
    """``vector_top_k_by_id`` for all rows that ``wanted`` holds for, however many: one plan, in which parts of the rows meet
    blocks of about ``block`` queries by an equi-join."""
    from recallium.operators.vector_index import exact_nearest

    asked = points.filter(wanted)
    best = exact_nearest(points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), asked.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q")), k, block=block)
    out = points.drop(vector_col).join(best.withColumnRenamed("id", id_col), id_col)
    return out.join(asked.select(F.col(id_col).alias("query_id"), F.col(label_col).alias("query_label")), "query_id") if label_col else out


def _nearest(points: DataFrame, wanted: Column, k: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    q = points.filter(wanted).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_q"), *([F.col(label_col).alias("query_label")] if label_col else []))
    pairs = points.join(F.broadcast(q), F.col(id_col) != F.col("query_id")).withColumn("score", scoring.cosine(F.col(vector_col), F.col("_q")))
    ranked = pairs.withColumn("rank", F.expr(f"row_number() over (partition by query_id order by score desc, {id_col})"))
    return ranked.filter(F.col("rank") <= k).drop("_q", vector_col)


def tokens(text: Column) -> Column:
    """Lower-case Unicode words, then each two neighbours joined by ``_``."""
    return _with_pairs(_words(text))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def _with_pairs(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(words, F.when(F.size(words) > 1, F.slice(pairs, 1, F.size(words) - 1)).otherwise(F.slice(words, 1, 0)))


def with_tokens(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep`` and ``t``, the tokens; words are a projection of their own, so the pattern runs once per text."""
    return spread(docs).select(*keep, _words(F.col(text_col)).alias("_w")).select("*", _with_pairs(F.col("_w")).alias("t")).drop("_w")


def with_words(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep`` and ``w``, the words joined by blanks, which no word holds: what ``with_tokens`` joins in pairs."""
    return spread(docs).select(*keep, F.array_join(_words(F.col(text_col)), " ").alias("w"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than there are cores (a small input); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bm25_frequencies(docs: DataFrame, text_col: str, terms: list[str] | None = None) -> DataFrame:
    """(term, n): documents per term (of ``terms`` only, if they are given), and under a null term the number of all
    tokens. Counts are summed before the shuffle, and no id goes with them. Searches can share it, written as a table."""
    t = with_tokens(docs.select(text_col), text_col)
    one = F.transform(F.array_distinct("t" if terms is None else F.filter("t", lambda x: x.isin(terms))), lambda x: F.struct(x.alias("term"), F.lit(1).cast("long").alias("n")))
    rows = t.select(F.explode(F.concat(one, F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("t").cast("long").alias("n"))))).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.n").alias("n"))


def bm25_search(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, frequencies: DataFrame | None = None) -> DataFrame:
    """``queries`` (query_id, text; a stated set). Top k per query: query_id, id, ``score`` above 0, ``rank`` from 0.

    A negative idf becomes ``eps`` times the mean idf over all terms. Statistics are over all documents (given as
    ``frequencies``, or counted here: of the queries' terms, and of all terms only where that mean is asked for); the driver gets one row of them, with the queries' own terms. Each document's
    words are then cut down to those terms and counted inside its row, so only hits leave it.
    """
    wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = sorted({r.term for r in wanted.select("term").distinct().collect()})  # of the stated queries
    n = docs.count()
    idf = F.when(F.col("term").isNotNull(), F.log(n - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    chosen = F.when(F.col("term").isin(terms), F.struct("term", idf.alias("idf"))) if terms else F.lit(None).cast("struct<term:string,idf:double>")
    s = (bm25_frequencies(docs, text_col, terms) if frequencies is None else frequencies).agg(F.avg(idf).alias("mean"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("all"), F.collect_list(chosen).alias("of")).first()
    mean = s.mean
    if frequencies is None and any(r.idf < 0 for r in s.of):
        mean = bm25_frequencies(docs, text_col).agg(F.avg(idf)).first()[0]
    weights = [(r.term, r.idf if r.idf >= 0 else eps * mean) for r in s.of]
    avgdl = (s.all or 0) / n if n else 0.0
    known = F.broadcast(wanted.join(docs.sparkSession.createDataFrame(weights, "term string, w double"), "term"))
    t = with_tokens(docs.select(id_col, text_col), text_col, F.col(id_col).alias("id"))
    t = t.select("id", F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(terms)).alias("h")).filter(F.size("h") > 0)
    hits = t.select("id", "dl", F.explode(F.transform(F.array_distinct("h"), lambda x: F.struct(x.alias("term"), F.size(F.filter("h", lambda y: y == x)).alias("tf")))).alias("x"))
    hits = hits.select("id", "dl", "x.term", "x.tf").join(known, "term")
    score = F.sum(F.col("qtf") * F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (avgdl or 1.0))))
    out = hits.groupBy("query_id", "id").agg(F.round(score, 6).alias("score")).filter("score > 0")
    return out.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, id) - 1")).filter(F.col("rank") < k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Ranked lists (key columns, ``rank`` from 0) to the summed 1 / (k + rank + 1), with each key's best rank and list."""
    tagged = [d.select(*key, "rank", F.lit(i).alias("list")) for i, d in enumerate(lists)]
    every = tagged[0]
    for d in tagged[1:]:
        every = every.unionByName(d)
    return every.groupBy(*key).agg(F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 6).alias("score"), F.min(F.struct("rank", "list")).alias("_b")).select(*key, "score", F.col("_b.rank").alias("best_rank"), F.col("_b.list").alias("best_list"))


def recall(memories: DataFrame, query: list[float], k: int, now: datetime, entities: list[str] | None = None, where: Column | None = None, reranked: bool = False, prefilter: bool = False) -> DataFrame:
    """Over-fetch three times k by similarity, hide superseded and dirty rows, score, cut to k.

    The cut to 3k comes before hiding, so fewer than k rows can be left; ``prefilter`` hides first. Memories need id,
    embedding, salience, pinned, captured_at, superseded_by, dirty and, for the boost, entities.
    """
    visible = current_only()
    rows = memories.filter(visible) if prefilter else memories
    pool = vector_top_k(rows, query, k * OVERFETCH, where=where).drop("rank").filter(visible)
    at = F.lit(now).cast("timestamp_ntz")
    if reranked:
        score = scoring.rerank_score(F.col("score"), F.col("salience"), F.col("pinned"), F.col("captured_at"), at)
    else:
        score = scoring.time_decay(F.col("score"), F.col("captured_at"), F.col("salience"), F.col("pinned"), at)
        if entities:
            score = scoring.entity_boost(score, F.col("entities"), F.array(*map(F.lit, entities)))
    return pool.withColumn("final_score", F.round(score, 6)).orderBy(F.desc("final_score"), F.asc("id")).limit(k)


def personal_context(memories: DataFrame, now: datetime, lookback_days: int = 7, recent: int = 20, cap: int = 30) -> DataFrame:
    """Pinned rows (at most ``cap``), those of the last days (at most 50) and the newest, without repeats, newest first."""
    rows = memories.filter(current_only())
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{lookback_days}' DAY")
    newest = [F.desc("captured_at"), F.asc("id")]
    parts = [rows.filter("pinned").orderBy(*newest).limit(cap), rows.filter(F.col("captured_at") >= since).orderBy(*newest).limit(50), rows.orderBy(*newest).limit(recent)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["id"]).orderBy(*newest).limit(cap)


def on_this_day(memories: DataFrame, now: datetime, tolerance: int = 2, least_age: int = 180, pool: int = 500, n: int = 5) -> DataFrame:
    """Old memories whose day of the year is within the tolerance of today's, in this year's calendar."""
    at = F.lit(now).cast("timestamp_ntz")
    old = memories.filter(F.col("captured_at") <= at - F.expr(f"INTERVAL '{least_age}' DAY")).orderBy(F.desc("salience"), F.desc("captured_at"), F.asc("id")).limit(pool)
    this_year = F.coalesce(F.try_make_timestamp_ntz(F.year(at), F.month("captured_at"), F.day("captured_at"), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp_ntz(F.year(at), F.month("captured_at"), F.lit(28), F.lit(0), F.lit(0), F.lit(0)))
    same = old.filter(F.abs(F.datediff(this_year, at)) <= tolerance)
    days = F.floor(F.timestamp_diff("SECOND", F.col("captured_at"), at) / 86400)
    return same.withColumn("age", age_label(days)).orderBy(F.desc("salience"), F.desc("captured_at"), F.asc("id")).limit(n)


def age_label(days: Column) -> Column:
    """``n years ago`` from 365 days on, else months; halves round to even."""
    y = F.bround(days / 365).cast("int")
    m = F.greatest(F.lit(1), F.bround(days / 30).cast("int"))
    word = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n != 1, "s").otherwise(""), F.lit(" ago"))
    return F.when(days >= 365, word(y, "year")).otherwise(word(m, "month"))


def themes(memories: DataFrame, since: datetime, n: int = 5) -> DataFrame:
    """The window's commonest tags; ties by first appearance (oldest row id, then place)."""
    t = memories.filter(F.col("captured_at") >= F.lit(since).cast("timestamp_ntz")).select("id", F.posexplode("tags").alias("pos", "theme"))
    return t.groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("_f")).orderBy(F.desc("n"), F.asc("_f")).limit(n).drop("_f")


def stack_recall(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two passes (id, rank) united by id, the earlier pass and rank kept, cut to 2k."""
    every = first.select("id", "rank", F.lit(0).alias("pass")).unionByName(second.select("id", "rank", F.lit(1).alias("pass")))
    best = every.groupBy("id").agg(F.min(F.struct("pass", "rank")).alias("b")).select("id", F.col("b.pass").alias("pass"), F.col("b.rank").alias("rank"))
    return best.orderBy("pass", "rank", "id").limit(2 * k)


def keyset_page(rows: DataFrame, after: int | None, n: int, id_col: str = "id") -> DataFrame:
    """The next n rows by id after a checkpoint."""
    return (rows if after is None else rows.filter(F.col(id_col) > after)).orderBy(id_col).limit(n)


def bump(memories: DataFrame, recalled: DataFrame) -> DataFrame:
    """Salience and recall count after a batch of recalls (id once per recall; each distinct id is bumped once)."""
    hit = recalled.select("id").distinct().withColumn("_hit", F.lit(True))
    return memories.join(hit, "id", "left").withColumn("salience", F.when(F.col("_hit"), scoring.next_salience(F.col("salience"))).otherwise(F.col("salience"))).withColumn("recall_count", F.col("recall_count") + F.when(F.col("_hit"), 1).otherwise(0)).drop("_hit")


def offline_score(text: Column, query: Column, keywords: Column) -> Column:
    """Query terms longer than two characters that the text contains, plus three times the keyword coverage."""
    from recallium.functions.text import keyword_coverage, normalise

    terms = F.filter(F.split(normalise(query), " "), lambda t: F.length(t) > 2)
    return F.size(F.filter(terms, lambda t: F.contains(normalise(text), t))) + 3 * keyword_coverage(text, keywords)
