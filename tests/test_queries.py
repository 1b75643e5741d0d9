"""Every registered query against its SQL, over the smallest tables; the rest must run and repeat."""

import collections
import os

import duckdb
import pytest

from gridloom.plans import catalog, matrix_queries, raster_queries, scene_queries  # noqa: F401

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(small, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, small, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == collections.Counter(tuple(plain(r[k]) for k in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_columns_and_push_filters(spark, small):
    plan = catalog.QUERIES["summary"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "ReadSchema: struct<o_totalprice:double>" in plan
    invert = catalog.QUERIES["invert"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in invert and "Python" not in invert
