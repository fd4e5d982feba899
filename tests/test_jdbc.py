"""The source scan over JDBC, against the Derby database that comes with Spark."""

import uuid

import pytest
from pyspark.sql import functions as F

from changelake.operators import quality
from changelake.sources import tables
from tests.conftest import SF

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def database(spark):
    """Orders (with a hole in their keys), nations and an empty table in a database in memory."""
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]};create=true"
    src = tables.parquet_tables(spark, SF)
    orders = src("orders").withColumn("o_orderkey", F.when(F.col("o_orderkey") > 100, F.col("o_orderkey") + 5_000_000).otherwise(F.col("o_orderkey")))
    put = lambda df, name: df.coalesce(1).write.option(
        "createTableColumnTypes", ", ".join(f"{f.name} VARCHAR(200)" for f in df.schema if f.dataType.simpleString() == "string")
    ).jdbc(url, name, properties=DRIVER)
    put(orders, "APP.orders")
    put(src("nation"), "APP.nation")
    put(orders.limit(0), "APP.customer_orders")
    return url, orders, src("nation")


def test_parts_are_of_equal_size(spark, database):
    url, orders, _ = database
    df = tables.jdbc_by_quantiles(spark, url, "APP.orders", "o_orderkey", 6, **DRIVER)
    assert df.rdd.getNumPartitions() == 6
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) < 1.3 * min(sizes) and sum(sizes) == orders.count()
    even = tables.jdbc_table(spark, url, "APP.orders", "o_orderkey", 1, 5_002_000, 6, **DRIVER)
    by_range = [r.n for r in even.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(by_range) > 0.8 * orders.count()            # what the quantiles are for


def test_filters_and_columns_reach_the_database(spark, database):
    url, orders, _ = database
    df = tables.jdbc_by_quantiles(spark, url, "APP.orders", "o_orderkey", 4, **DRIVER).where("o_custkey = 7").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull" in plan and "*EqualTo" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]
    assert sorted(r[0] for r in df.collect()) == sorted(r[0] for r in orders.where("o_custkey = 7").select("o_orderkey").collect())


def test_reconcile_with_a_database(spark, database):
    url, orders, nation = database
    source = tables.jdbc_tables(spark, url, "APP", 4, **DRIVER)
    left = {t: source(t) for t in ("orders", "nation")}
    right = {"orders": orders.withColumn("_cdc_op", F.lit("r")), "nation": nation}
    result = {r.table_name: r for r in quality.compare(left, right).collect()}
    assert all(r.ok and r.checksum_match for r in result.values()) and result["orders"].source_rows == orders.count()
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 3, F.lit(1)).otherwise(F.col("o_totalprice")).cast("decimal(12,2)"))
    result = {r.table_name: r.ok for r in quality.compare(left, {"orders": changed, "nation": nation.limit(3)}).collect()}
    assert result == {"orders": False, "nation": False}
    assert [r.asDict() for r in quality.count_lag(left, {"orders": orders, "nation": nation}).collect()] == []


def test_empty_and_small_tables(spark, database):
    url, _, nation = database
    assert tables.key_quantiles(spark, url, "APP.customer_orders", "o_orderkey", 4, **DRIVER) == []
    assert tables.jdbc_by_quantiles(spark, url, "APP.customer_orders", "o_orderkey", 4, **DRIVER).count() == 0
    few = tables.jdbc_by_quantiles(spark, url, "APP.nation", "n_nationkey", 40, **DRIVER)
    assert few.count() == nation.count() and few.select("n_nationkey").distinct().count() == nation.count()
