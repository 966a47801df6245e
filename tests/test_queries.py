"""Each registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from recallium.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, (list, tuple)) or getattr(x, "ndim", 0):
        return str([str(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA:
        return "NULL"
    if isinstance(x, bool) or "bool" in type(x).__name__:
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return "NULL" if math.isnan(x) else f"{round(float(x), 6) + 0.0:.6f}"
    return str(x)


def rows(df):
    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, db, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        want = db.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "score", "final_score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
