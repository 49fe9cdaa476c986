"""Every registered raster query against its SQL in DuckDB, on the smallest tables."""

import gc
import math

import duckdb
import pytest

from rasterloom.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in ("lineitem", "events", "embeddings", "orders"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(rows):
    even = lambda v: round(v, 7) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(even(v) for v in r) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    want = duck.sql(oracle.SQL[name])
    assert found.columns == want.columns
    assert plain(map(tuple, found.collect())) == plain(want.fetchall())


@pytest.mark.parametrize("name", ["candidate_pool", "graph_summary"])
def test_queries_leave_nothing_in_the_cache(spark, name):
    count = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = count()
    found = catalog.QUERIES[name](spark, SF)
    found.collect()
    assert count() > before
    del found
    gc.collect()
    assert count() == before
