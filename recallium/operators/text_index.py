"""A stored inverted index for BM25: postings by term, in runs of documents that are inverted where they are read.

A task inverts its own documents, some thousands at a time, and writes a row for each term of such a run, so no posting is
shuffled, and a term is stored once a run. Terms are hashed (by their first word) into folders, so a search opens the folders of
its own terms and, by the files' statistics, the row groups that hold them. A run's documents stand in groups; the greatest
impact of a term in a group bounds what a document of the group can score. A search scores the most promising groups first,
takes the k-th best score as the threshold, and scores of the other groups only those whose bound reaches it: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.operators.ranking import tokens, with_words
from recallium.streaming.replay import settings

GROUP_DOCS = 4096
RUN_DOCS = 8192
RUN_WEIGHT = 1 << 21
OUT_ROWS = 1 << 15
PACKED_TERMS = 1 << 19
FIRST_GROUPS = 4
DOCS_BUCKET = -1  # the folder of the runs' documents
#: Terms are no dictionary, since each comes once a run; this version stores what a term has beyond the one before.
_WRITTEN = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#term": "false"}
_STORED = "term string, run long, n int, docs array<int>, tfs array<int>"


def _bucket(term: Column, buckets: int) -> Column:
    """By the first word, so that terms that begin alike stand together and are stored in little space."""
    return F.pmod(F.crc32(F.substring_index(term, "_", 1).cast("binary")), F.lit(buckets)).cast("int")


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """``_bucket`` of the terms that begin with these words."""
    return np.fromiter((crc32(w.partition("_")[0].encode()) % buckets for w in words.to_pylist()), np.int32, len(words))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """(id, words joined by blanks) to ids and lists of words: a single document, or ``RUN_DOCS`` at most, whose words and eighths of bytes
    are ``RUN_WEIGHT`` at most."""
    lot, docs, weight = [], 0, 0
    for b in batches:
        lists = pc.split_pattern(b.column(1), " ")
        lists = pc.if_else(pc.equal(b.column(1), ""), pa.scalar([], lists.type), lists)
        at = 0
        for k, w in enumerate(pc.add(pc.list_value_length(lists), pc.divide(pc.binary_length(b.column(1)), 8)).to_pylist()):
            if docs and (docs == RUN_DOCS or weight + w > RUN_WEIGHT):
                lot.append((b.column(0)[at:k], lists[at:k]))
                yield _whole(lot)
                docs, weight, at = 0, 0, k
            docs, weight = docs + 1, weight + w
        lot.append((b.column(0)[at:], lists[at:]))
    if docs:
        yield _whole(lot)


def _whole(lot: list[tuple[pa.Array, pa.ListArray]]) -> tuple[pa.Array, pa.ListArray]:
    ids, lists = (pa.concat_arrays(x) for x in zip(*lot, strict=True))
    lot.clear()
    return ids, lists


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _inverted(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents to the sorted words, the numbers of the terms (words, and neighbours joined by ``_``), where a term's
    postings begin, the postings' documents, and how often the term is in them."""
    n, sizes = max(len(lists), 1), pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code, doc, size = rank[coded.indices.to_numpy()], np.repeat(np.arange(len(lists)), sizes), len(order) + 1
    inner = doc[1:] == doc[:-1]
    # A term's number: its first word's, and 0 or its second word's; with the document's, it is below 2 ** 63 for all runs.
    every = np.empty(len(code) + np.count_nonzero(inner), np.int64)
    np.multiply(code, size * n, out=every[: len(code)])
    every[: len(code)] += doc
    pairs = every[len(code) :]
    pairs[:] = code[:-1][inner]
    pairs *= size
    pairs += code[1:][inner]
    pairs += 1
    pairs *= n
    pairs += doc[:-1][inner]
    del code, doc, coded, inner
    every.sort()
    at = _starts(every)
    tf = np.diff(at, append=len(every)).astype(np.int32)
    every = every[at]
    doc = (every % n).astype(np.int32)
    every //= n
    at = _starts(every)
    key = every[at]
    joined = pc.match_substring(words, "_").to_numpy(zero_copy_only=False)
    if joined.any():  # then a term may have come from several words: a_b, or a and b
        first, second = np.divmod(key, size)
        unsure = _named(words, key[joined[first] | ((second > 0) & joined[second - 1])])
        own = np.concatenate([k + np.flatnonzero(pc.is_in(_named(words, key[k : k + OUT_ROWS]), unsure).to_numpy(zero_copy_only=False)) for k in range(0, len(key), OUT_ROWS)])
        same = _named(words, key[own]).dictionary_encode().indices.to_numpy()
        owner = np.arange(len(key))
        owner[own] = own[np.unique(same, return_index=True)[1]][same]
        every = np.repeat(owner, np.diff(at, append=len(doc))) * n + doc
        order = np.argsort(every, kind="stable")
        every = every[order]
        begin = _starts(every)
        tf, every = np.add.reduceat(tf[order], begin, dtype=np.int32), every[begin]
        doc = (every % n).astype(np.int32)
        every //= n
        at = _starts(every)
        key = key[every[at]]
    return words, key, at, doc, tf


def _named(words: pa.Array, key: np.ndarray) -> pa.Array:
    first, second = np.divmod(key, len(words) + 1)
    left = words.take(pa.array(first))
    return pc.if_else(pa.array(second == 0), left, pc.binary_join_element_wise(left, words.take(pa.array(np.maximum(second - 1, 0))), "_"))


def _blocks(buckets: int):
    """(id, words) to rows of terms, nearly in order, and, under a null term, a row of each run's documents and their lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        names = ["term", "run", "n", "docs", "tfs", "ids", "dls", "bucket"]
        none = lambda n, kind: pa.nulls(n, pa.list_(kind))
        one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
        for ids, lists in _runs(batches):
            number += 1
            dls = np.maximum(2 * pc.list_value_length(lists).to_numpy() - 1, 0)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), pa.array([len(ids)], pa.int32()), none(1, pa.int32()), none(1, pa.int32()), one(ids), one(pa.array(dls, pa.int32())), pa.array([DOCS_BUCKET], pa.int32())], names)
            words, key, at, doc, tf = _inverted(lists)
            del lists
            of_word = _buckets(words, buckets)
            ends = np.append(at, len(doc))
            for k in range(0, len(at), OUT_ROWS):
                e = ends[k : k + OUT_ROWS + 1]
                d, f, n = doc[e[0] : e[-1]], tf[e[0] : e[-1]], np.diff(e)
                once = np.maximum.reduceat(f, e[:-1] - e[0]) == 1  # in each document: not stored
                docs = pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), pa.array(d, pa.int32()))
                tfs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n * ~once)), pa.int32()), pa.array(f[np.repeat(~once, n)], pa.int32()), mask=pa.array(once))
                yield pa.RecordBatch.from_arrays([_named(words, key[k : k + OUT_ROWS]), pa.array(np.full(len(n), number)), pa.array(n, pa.int32()), docs, tfs, none(len(n), ids.type), none(len(n), pa.int32()), pa.array(of_word[key[k : k + OUT_ROWS] // (len(words) + 1)])], names)

    return run


def _packed():
    """(part, term, n) to (part, terms, size, ns): counts summed, terms as one compressed text, since neighbours are much alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, rows = [], 0
        for b in batches:
            lot.append(b)
            rows += b.num_rows
            if rows >= PACKED_TERMS:
                yield pack(lot)
                lot, rows = [], 0
        if rows:
            yield pack(lot)

    def pack(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(lot).group_by("term", use_threads=False).aggregate([("part", "min"), ("n", "sum")]).combine_chunks()
        part = t["part_min"].to_numpy()
        order = np.argsort(part, kind="stable")
        at = _starts(part[order])
        ends = pa.array(np.append(at, len(order)), pa.int32())
        lists = lambda name: pa.ListArray.from_arrays(ends, t[name].combine_chunks().take(pa.array(order)))
        texts = pc.binary_join(lists("term"), "\n")
        return pa.RecordBatch.from_arrays([pa.array(part[order][at]), pa.array([pa.compress(x.as_buffer(), "zstd", asbytes=True) for x in texts]), pc.binary_length(texts), lists("n_sum")], ["part", "terms", "size", "ns"])

    return run


def _idf_sums(docs: int):
    """All packed terms of a part to the number of distinct ones and the sum of their idf."""
    def run(t: pa.Table) -> pa.Table:
        text = [pa.decompress(x.as_buffer(), n, "zstd").to_pybytes().decode() for x, n in zip(t["terms"], t["size"].to_pylist(), strict=True)]
        terms = pc.list_flatten(pc.split_pattern(pa.array(text, pa.large_string()), "\n"))
        n = pa.table({"t": terms, "n": pc.list_flatten(t["ns"])}).group_by("t", use_threads=False).aggregate([("n", "sum")])["n_sum"].to_numpy()
        return pa.table({"terms": pa.array([len(n)]), "idf": pa.array([float((np.log(docs - n + 0.5) - np.log(n + 0.5)).sum())])})

    return run


class TextIndex:
    """A BM25 index in a folder. ``k1``, ``b`` and ``eps`` are fixed when it is built."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, docs: DataFrame, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, buckets: int = 32, group_docs: int = GROUP_DOCS) -> TextIndex:
        """Index all documents; a null text is empty. Ids should be unique (rows of one id are documents of their own in
        the counts and add up in a search, as in ``bm25_search``; then all groups are scored)."""
        kind = docs.schema[id_col].dataType.simpleString()
        rows = with_words(docs.select(id_col, text_col), text_col, F.col(id_col).alias("id")).mapInArrow(_blocks(buckets), f"{_STORED}, ids array<{kind}>, dls array<int>, bucket int")
        # Each folder's rows stay in their order, without a sort.
        with settings(self.spark, spark__sql__maxConcurrentOutputFileWriters=str(buckets + 2), spark__sql__execution__arrow__maxRecordsPerBatch="1024"):
            rows.write.options(**_WRITTEN).partitionBy("bucket").parquet(f"{self.path}/blocks")
        runs = self._stored(kind).filter(F.col("bucket") == DOCS_BUCKET)
        n, total, groups = runs.agg(F.sum(F.size("ids").cast("long")), F.sum(F.expr("aggregate(dls, 0L, (s, x) -> s + x)")), F.sum(F.ceil(F.size("ids") / group_docs))).first()
        n = n or 0
        avgdl = ((total or 0) / n if n else 0.0) or 1.0
        unique = runs.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        meta = [(n, float(avgdl), self._mean_idf(kind, buckets, n), float(k1), float(b), float(eps), buckets, max(1, groups or 0), group_docs, unique, kind)]
        self.spark.createDataFrame(meta, "n long, avgdl double, mean double, k1 double, b double, eps double, buckets int, groups long, group_docs int, unique boolean, kind string").coalesce(1).write.parquet(f"{self.path}/meta")
        return self

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"{_STORED}, ids array<{kind}>, dls array<int>, bucket int").parquet(f"{self.path}/blocks")

    def _mean_idf(self, kind: str, buckets: int, docs: int) -> float:
        """Over all terms: counts are packed before they are shuffled, since most terms are rare and their texts take the space.
        A part has terms of one folder that begin alike, about ``PACKED_TERMS`` of them with repeats."""
        heads = self._stored(kind).filter(F.col("bucket") != DOCS_BUCKET)
        parts = max(1, -(-heads.count() // (PACKED_TERMS * buckets)))
        beginning = F.expr("substring(term, 1, length(substring_index(term, '_', 1)) + 2)")
        part = F.col("bucket") * parts + F.pmod(F.xxhash64(beginning), F.lit(parts)).cast("int")
        packed = heads.select(part.alias("part"), "term", "n").mapInArrow(_packed(), "part int, terms binary, size int, ns array<bigint>")
        s = packed.groupBy("part").applyInArrow(_idf_sums(docs), "terms long, idf double").agg(F.sum("terms").alias("n"), F.sum("idf").alias("idf")).first()
        return s.idf / s.n if s.n else 0.0

    def search(self, queries: DataFrame, k: int, first_groups: int = FIRST_GROUPS) -> DataFrame:
        """``bm25_search`` on the index: query_id, id, ``score`` above 0, ``rank`` from 0, for a stated set of queries."""
        meta = self.spark.read.parquet(f"{self.path}/meta").first()
        wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        asked = wanted.withColumn("bucket", _bucket(F.col("term"), meta.buckets)).collect()  # of the stated queries
        terms, folders = sorted({r.term for r in asked}), sorted({r.bucket for r in asked})
        stored = self._stored(meta.kind)
        mine = stored.filter(F.col("bucket").isin(folders) & F.col("term").isin(terms))
        idf = {r.term: r.idf for r in mine.groupBy("term").agg(F.sum("n").alias("n")).select("term", (F.log(meta.n - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)).alias("idf")).collect()}
        rows = [(r.query_id, r.term, r.qtf * (idf[r.term] if idf[r.term] >= 0 else meta.eps * meta.mean)) for r in asked if r.term in idf]
        kind = queries.schema["query_id"].dataType.simpleString()
        weights = F.broadcast(self.spark.createDataFrame(rows, f"query_id {kind}, term string, w double"))  # terms of the stated queries
        runs = stored.filter(F.col("bucket") == DOCS_BUCKET).select("run", "ids", "dls")
        tf, dl = "coalesce(tfs[i], 1)", "dls[d]"
        impact = f"{tf} * {meta.k1 + 1}D / ({tf} + {meta.k1}D * ({1 - meta.b}D + {meta.b}D * {dl} / {meta.avgdl}D))"
        posts = F.expr(f"transform(docs, (d, i) -> struct(run * {1 << 20} + d div {meta.group_docs} as g, ids[d] as id, {impact} as impact))")
        blocks = mine.select("term", "run", "docs", "tfs").join(runs, "run").select("term", F.explode(posts).alias("p")).select("term", "p.*")
        if meta.groups <= first_groups or not meta.unique:
            return _top(_scored(blocks, weights, None), k)
        heads = blocks.groupBy("term", "g").agg(F.max("impact").alias("most")).join(weights, "term")
        bounds = heads.groupBy("query_id", "g").agg(F.sum(F.greatest(F.lit(0.0), F.col("w") * F.col("most"))).alias("bound"))
        bounds = bounds.withColumn("place", F.expr("row_number() over (partition by query_id order by bound desc, g)")).persist()
        try:
            early = _top(_scored(blocks, weights, bounds.filter(F.col("place") <= first_groups).select("query_id", "g")), k).persist()
            least = early.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).select("query_id", "s")
            rest = bounds.filter(F.col("place") > first_groups).join(least, "query_id", "left").filter("bound > 0 and (s is null or bound >= s - 0.000001)").select("query_id", "g")
            late = _scored(blocks, weights, rest)
            out = _top(early.select("query_id", "id", "score").unionByName(late), k)
            rows = out.collect()  # k rows a stated query
        finally:
            bounds.unpersist()
        return self.spark.createDataFrame(rows, out.schema)


def _scored(blocks: DataFrame, weights: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(query_id, id, score above 0) of the documents in the given (query_id, g), or in all groups."""
    hit = blocks.join(weights, "term")
    if groups is not None:
        hit = hit.join(groups, ["query_id", "g"])
    each = hit.select("query_id", "id", (F.col("w") * F.col("impact")).alias("s"))
    return each.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score")).filter("score > 0")


def _top(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, id) - 1")).filter(F.col("rank") < k)
