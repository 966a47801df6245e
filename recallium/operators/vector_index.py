"""Inverted-file index of vectors: cells round centroids, probed by need, scored exactly; and the exact search beside it.

Centroids are fitted on a bounded sample, and so is the number of cells that a search probes; every row is then put into its nearest cell and the rows are written by
cell, so that a search reads only the cells that it probes. Queries and rows meet cell by cell in tasks of bounded
size: a cell that holds a third of all rows is dealt in parts, and many queries in blocks. Each meeting gives at most
k rows a query, which are ranked once more over all meetings.
"""

from __future__ import annotations


import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallium.sources.stores import Folder

SAMPLE_ROWS = 20_000  # the documented bound of the sample that centroids are fitted on: rows least by a hash of their id
MOST_CELLS = 4096
PART_ROWS = 20_000
BLOCK_QUERIES = 1_000
SLICE_QUERIES = 64  # queries whose scores against a part are held at a time
FIT_QUERIES = 512  # rows of the sample that the number of probes is measured on
FIT_RECALL = 0.95  # above the 0.9 that a search should reach, for the sample's error
FITTED = -1
ROUNDS = 12


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; a row of zeros stays so."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def fit_centroids(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; a cell that loses all its rows takes the row that fits its own cell worst."""
    x = unit(vectors.astype(np.float64))
    x = np.unique(x, axis=0)
    if not len(x):
        return np.zeros((1, vectors.shape[1] if vectors.ndim == 2 else 1))
    cells = min(cells, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        s = x @ c.T
        own = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(s[np.arange(len(x)), own])[: len(empty)]]
        c = unit(sums)
    return c


def _nearest_cells(centroids: np.ndarray, probes: int):
    def cells(v: pd.Series) -> pd.Series:
        m = unit(np.stack([np.asarray(x, np.float64) for x in v])) if len(v) else np.zeros((0, centroids.shape[1]))
        s = m @ centroids.T
        best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        return pd.Series(list(best.astype(np.int32)))

    return F.pandas_udf(cells, "array<int>")


def fit_probes(vectors: np.ndarray, centroids: np.ndarray, k: int = 10) -> int:
    """The least number of probed cells by which the sample's own rows find ``FIT_RECALL`` of their k nearest in it.

    In all rows the nearest are nearer than in a sample, so fewer cells hold them: the number errs to the safe side.
    """
    x = unit(vectors.astype(np.float64))
    if len(x) < 2:
        return len(centroids)
    own = np.concatenate([(x[at : at + FIT_QUERIES] @ centroids.T).argmax(1) for at in range(0, len(x), FIT_QUERIES)])
    asked = np.arange(min(FIT_QUERIES, len(x)))
    s = x[asked] @ x.T
    s[asked, asked] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(FIT_RECALL * len(needed))) - 1)])


class VectorIndex:
    """An index in a folder. Rows without a vector, or with one of another length than most, are refused by ``build``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, points: DataFrame, id_col: str, vector_col: str, cells: int | None = None) -> VectorIndex:
        """Write all rows (id, vector, other columns) by cell, beside the centroids. About the root of the rows many cells."""
        if not points.filter(F.col(vector_col).isNull()).isEmpty():
            raise ValueError("rows without a vector")
        many = points.count()
        cells = min(cells or max(1, round(many**0.5)), MOST_CELLS)
        sample = points.select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).select(vector_col).collect()
        rows = np.array([r[0] for r in sample], np.float64) if sample else np.zeros((0, 1))
        c = fit_centroids(rows, cells)
        self.spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")  # bounded: MOST_CELLS rows
        placed = points.withColumn("cell", _nearest_cells(c, 1)(vector_col)[0]).withColumnsRenamed({id_col: "id", vector_col: "vector"})
        Folder(self.spark, self.path).create("schema.json", placed.schema.json())
        Folder(self.spark, self.path).create("probes.json", json.dumps(fit_probes(rows, c)))
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, many // (PART_ROWS * 64))))).write.partitionBy("cell").parquet(f"{self.path}/rows")
        return self

    def centroids(self) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(f"{self.path}/centroids").collect())
        return np.array([r.centroid for r in rows])

    def rows(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(Folder(self.spark, self.path).read("schema.json")))
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int | None = FITTED, where: Column | None = None, id_col: str = "id", vector_col: str = "vector", itself: bool = False) -> DataFrame:
        """The k nearest rows by cosine of each query row: query_id, id, score, rank (from 1; ties by id).

        ``where`` filters the indexed rows inside the probed cells, before they are scored. ``probes`` is the number that
        the build measured on its sample, unless it is given; None, or all cells, is exact. A row is not its own neighbour unless ``itself``.
        """
        c = self.centroids()
        if probes == FITTED:
            probes = json.loads(Folder(self.spark, self.path).read("probes.json"))
        exact = probes is None or probes >= len(c)
        points = self.rows()
        # Of few queries, the cells to be read are known before the scan and prune it.
        asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q"))
        if exact:
            return exact_nearest(points.filter(where) if where is not None else points, asked, k, itself)
        asked = asked.withColumn("cell", F.explode(_nearest_cells(c, probes)("q")))
        wanted = [r[0] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
        points = points.filter(F.col("cell").isin(wanted))
        return nearest_by_cell(points.filter(where) if where is not None else points, asked, k, itself)


def exact_nearest(points: DataFrame, asked: DataFrame, k: int, itself: bool = False, block: int | None = None) -> DataFrame:
    """All rows (id, vector) against all queries (query_id, q), block by block: the brute-force search."""
    return nearest_by_cell(points.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0)), k, itself, block)


def _meeting(k: int, itself: bool):
    """Scores of a part and a block; of a ``SLICE_QUERIES`` of them at a time."""
    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        order = np.argsort(a["id"].to_numpy(), kind="stable")
        ids, x = a["id"].to_numpy()[order], unit(np.stack(a["vector"].to_numpy()).astype(np.float64))[order]
        names, ats, scores = [], [], []
        for at in range(0, len(b), SLICE_QUERIES):
            some = b.iloc[at : at + SLICE_QUERIES]
            qs = unit(np.stack(some["q"].to_numpy()).astype(np.float64))
            for name, row in zip(some["query_id"], np.round(qs @ x.T, 12), strict=True):
                if not itself:
                    row = np.where(ids == name, -np.inf, row)
                # The k best, and all that tie with the last of them: ids decide among those.
                least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                best = np.flatnonzero((row >= least) & (row > -np.inf))
                best = best[np.argsort(-row[best], kind="stable")][:k]
                names += [name] * len(best)
                ats.append(best)
                scores.append(row[best])
        return pd.DataFrame({"query_id": names, "id": ids[np.concatenate(ats)], "score": np.concatenate(scores)})

    return meet


def nearest_by_cell(points: DataFrame, asked: DataFrame, k: int, itself: bool = False, block: int | None = None) -> DataFrame:
    """Rows and queries of equal ``cell`` meet, a part of at most about PART_ROWS with a block of about BLOCK_QUERIES at a time."""
    sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).selectExpr("cell", f"cast(ceil(n / {PART_ROWS}) as int) as parts")
    loads = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).selectExpr("cell", f"cast(ceil(n / {block or BLOCK_QUERIES}) as int) as blocks")
    plan = sizes.join(loads, "cell")  # a row per cell
    p = points.select("id", "vector", "cell").join(plan, "cell").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    q = asked.select("query_id", "q", "cell").join(plan, "cell").withColumn("block", F.expr("cast(pmod(xxhash64(query_id), blocks) as int)")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    kind, qkind = points.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    key = ["cell", "part", "block"]
    met = p.select("id", "vector", *key).groupBy(*key).cogroup(q.select("query_id", "q", *key).groupBy(*key)).applyInPandas(_meeting(k, itself), f"query_id {qkind}, id {kind}, score double")
    ranked = met.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, id)"))
    return ranked.filter(F.col("rank") <= k)


def recall_against(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries, pairs of the truth, and the share of them that was found."""
    hit = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
