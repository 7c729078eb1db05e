"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from vaultspark.plans.catalog import QUERIES
from vaultspark.plans.fixtures import TABLES, VIEWS, ctes, view
from vaultspark.plans.oracles import ORACLE


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(rows):
    one = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    assert got, name
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert got == plain(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", VIEWS)
def test_view(spark, sf, duck, name):
    assert plain(view(spark, sf, name).collect()) == plain(duck.execute(f"{ctes(name)} select * from {name}").fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan_and_ranks_are_cut_early(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("source = 'src1'").select("doc_id")
    text = docs._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in text and "text" not in text.split("ReadSchema")[1]
    plan = QUERIES["vector_filtered"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = QUERIES["rrf_fuse"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "FullOuter" not in plan
