"""Connected components by alternating large-star and small-star steps; no node's neighbours are ever gathered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_caches, shuffle_width

MOST_NODES = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges: each node that is not its tree's least becomes one edge to the least.

    At ``MOST_NODES`` nodes the forest so far is given out and another is begun, so a task's memory does not grow with
    the partition; both forests keep what their edges connect.
    """
    free_caches()
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    def edges() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
                parent.setdefault(min(a, c), min(a, c))
        if len(parent) > MOST_NODES:
            yield edges()
            parent.clear()
    if parent:
        yield edges()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v: long). Returns (node, comp) for each node with an edge to another; comp is the least node."""
    e = edges.filter("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v")
    e = e.repartition(shuffle_width(e.sparkSession)).mapInArrow(_forest, "u long, v long")  # dealt evenly, whatever hubs there are
    e = scratch.cut(e)
    while not _are_stars(e):
        both = e.unionByName(e.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.filter("v > u").join(least, "u").selectExpr("v u", "m v").filter("u <> v")
        large = scratch.cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.expr("array(struct(v as u, m as v), struct(u as u, m as v))")).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        nxt = scratch.cut(small)
        scratch.drop(large, e)
        e = nxt
    return e.selectExpr("u node", "v comp").unionByName(e.selectExpr("v node", "v comp")).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether each node has one edge down, to a node that has none: then every component is a star round its least node."""
    marks = e.distinct().selectExpr("inline(array(struct(u as x, 1 as down, 0 as up), struct(v as x, 0 as down, 1 as up)))")
    return marks.groupBy("x").agg(F.sum("down").alias("d"), F.max("up").alias("t")).filter("d > 1 or (d > 0 and t > 0)").isEmpty()
