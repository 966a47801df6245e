"""A search for many query rows does not depend on its blocks and leaves none out."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recallium.operators import ranking as R
from recallium.operators import vector_index as V


def test_blocks_of_queries(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    wanted = [r.vec_id for r in points.filter("vec_id % 20 = 0").collect()]
    assert len(wanted) > 8
    top = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    want = top(R.vector_top_k_by_id(points, wanted, 5, "vec_id", "embedding", "label"))
    assert len(want) == 5 * len(wanted)
    assert top(R.vector_top_k_where(points, F.col("vec_id") % 20 == 0, 5, "vec_id", "embedding", "label", block=7)) == want
    assert R.vector_top_k_where(points, F.col("vec_id") < 0, 5, "vec_id", "embedding", "label").count() == 0


def test_scores_of_a_block_are_held_in_slices():
    r = np.random.default_rng(4)
    points = pd.DataFrame({"id": np.arange(8_000), "vector": list(r.normal(size=(8_000, 8)))})
    asked = pd.DataFrame({"query_id": np.arange(1_000), "q": list(points["vector"][:1_000])})
    tracemalloc.start()
    try:
        out = V._meeting(3, False)(points, asked)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == 3_000 and peak < 8_000 * 1_000 * 8 / 2  # half of one matrix of all scores


def test_probes_are_measured(spark, tmp_path):
    """Vectors without any structure, whose neighbours lie in many cells."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r.normal(size=(3_000, 64)))], "id long, vector array<double>")
    asked = df.filter("id % 20 = 0")
    index = V.VectorIndex(spark, f"{tmp_path}/i").build(df, "id", "vector")
    truth = V.exact_nearest(df, asked.selectExpr("id as query_id", "vector as q"), 10)
    assert V.recall_against(index.search(asked, 10), truth).first().recall >= 0.9
