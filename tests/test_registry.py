"""Registered queries equal their SQL on the smallest data, and their plans scale."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from changelake.plans import registry, suite
from tests.conftest import SF

TABLES = ["region", "nation", "customer", "orders", "lineitem", "events"]


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.SQL:
        assert rows
        return
    res = db.execute(registry.SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and rows == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["region", "nation", "orders", "revenue"] and df.count() > 0


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    src = suite.ParquetSource(spark, SF)
    plan = executed(suite.q02(src, "1995-03-01", "1995-03-31"))
    assert "GreaterThanOrEqual(o_orderdate,1995-03-01" in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert "EqualTo(o_orderkey,480)" in executed(suite.q01(src, 480))


def test_large_customer_tables_join_after_adding_up(spark, monkeypatch):
    src = suite.ParquetSource(spark, SF)
    small = {r.nation: (r.orders, r.revenue) for r in suite.q04(src, "1996-01-01", "1997-01-01").collect()}
    segments = suite.q07(src, "1995-01-01", "1995-03-31").collect()
    monkeypatch.setattr(suite, "is_small", lambda df, limit=0: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = suite.q04(src, "1996-01-01", "1997-01-01")
        assert "BroadcastHashJoin" not in executed(df)
        assert {r.nation: (r.orders, r.revenue) for r in df.collect()} == small
        assert suite.q07(src, "1995-01-01", "1995-03-31").collect() == segments
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in (
    "stream_fold", "compact_fold", "lake_month_range", "purge_residue")])
def test_no_query_pairs_rows_without_a_key(spark, name):
    plan = executed(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
