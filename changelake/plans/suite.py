"""The analytic query suite and the ready-made table queries.

Every query takes a *source*: tables by name and date ranges of them. The same query runs on
plain Parquet tables and on lake tables, where a range also prunes month folders.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.lake import ChangeTable, Lake, month_range
from changelake.operators.metrics import dedup_batches
from changelake.operators.quality import counts
from changelake.plans.layout import content_stats, partitions, table_files
from changelake.session import is_small
from changelake.sources.tables import parquet_tables

# Fixed value: result size of an interactive query.
ROW_LIMIT = 1000


class ParquetSource:
    """Tables read from a folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self._tables = parquet_tables(spark, folder)

    def __call__(self, name: str) -> DataFrame:
        return self._tables(name)

    def between(self, name: str, column: str, lo: str, hi: str) -> DataFrame:
        return month_range(self(name), column, lo, hi, None)


class LakeSource:
    """Current state of lake tables."""

    def __init__(self, lake: Lake, namespace: str = "shop"):
        self._lake, self._namespace = lake, namespace

    def table(self, name: str) -> ChangeTable:
        return self._lake.table(f"{self._namespace}.{name}")

    def __call__(self, name: str) -> DataFrame:
        return self.table(name).current()

    def between(self, name: str, column: str, lo: str, hi: str) -> DataFrame:
        return self.table(name).scan_range(column, lo, hi)


def day_after(day: str) -> str:
    return (date.fromisoformat(day) + timedelta(days=1)).isoformat()


def join_dimension(df: DataFrame, dim: DataFrame, on: Column | str) -> DataFrame:
    """Inner join; the dimension is broadcast only when its size is known to be small."""
    return df.join(F.broadcast(dim) if is_small(dim) else dim, on)


def with_customer(orders: DataFrame, customer: DataFrame, extra: list[str]) -> DataFrame:
    """Order counts and totals joined to their customers.

    A small customer table is broadcast. A large one is joined after the orders have been added
    up per customer: the sums share the join's shuffle, and a customer with any share of the
    orders arrives as one row per task.
    """
    price = F.col("o_totalprice")
    on = F.col("o_custkey") == F.col("c_custkey")
    if is_small(customer):
        return (orders.join(F.broadcast(customer), on)
                .withColumns({"_orders": F.lit(1).cast("long"), "_total": price.cast("decimal(38,2)")}))
    sums = orders.groupBy("o_custkey", *extra).agg(
        F.count(F.lit(1)).alias("_orders"), F.sum(price).cast("decimal(38,2)").alias("_total"))
    return sums.join(customer, on)


def q01(src, orderkey: int) -> DataFrame:
    """Point lookup by key."""
    return src("orders").where(F.col("o_orderkey") == orderkey)


def q02(src, lo: str, hi: str) -> DataFrame:
    """Count and revenue between two days, both included."""
    return src.between("orders", "o_orderdate", lo, day_after(hi)).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue"))


def q03(src, lo: str, hi: str) -> DataFrame:
    """Quarterly count and revenue by status in [lo, hi)."""
    return (src.between("orders", "o_orderdate", lo, hi)
            .groupBy(F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("qtr"), "o_orderstatus")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue"))
            .orderBy("yr", "qtr", "o_orderstatus"))


def q04(src, lo: str, hi: str) -> DataFrame:
    """Revenue per region and nation in [lo, hi); orders of missing customers drop out."""
    orders = src.between("orders", "o_orderdate", lo, hi).select("o_custkey", "o_totalprice")
    customer = src("customer").select("c_custkey", "c_nationkey")
    per_nation = (with_customer(orders, customer, []).groupBy("c_nationkey")
                  .agg(F.sum("_orders").alias("orders"), F.sum("_total").alias("revenue")))
    named = join_dimension(per_nation, src("nation").select("n_nationkey", "n_name", "n_regionkey"),
                           F.col("c_nationkey") == F.col("n_nationkey"))
    placed = join_dimension(named, src("region").select("r_regionkey", "r_name"),
                            F.col("n_regionkey") == F.col("r_regionkey"))
    return (placed.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
            .agg(F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"))
            .orderBy(F.desc("revenue"), "region", "nation"))


def q05(src, k: int = 10) -> DataFrame:
    """Customers with the highest lifetime spend; equal spend is ordered by key."""
    spend = src("orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("orders"))
    customer = src("customer").select("c_custkey", "c_name", "c_mktsegment")
    return (join_dimension(spend, customer, F.col("o_custkey") == F.col("c_custkey"))
            .select("c_custkey", "c_name", "c_mktsegment", "spend", "orders")
            .orderBy(F.desc("spend"), "c_custkey").limit(k))


def q06(src) -> DataFrame:
    """Totals of the whole table and its distinct buyers."""
    return src("orders").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue"),
        F.avg("o_totalprice").alias("avg_order"), F.countDistinct("o_custkey").alias("customers"))


def q07(src, lo: str, hi: str, priorities: tuple[str, ...] = ("1-URGENT", "2-HIGH")) -> DataFrame:
    """Segment by priority between two days, both included."""
    orders = (src.between("orders", "o_orderdate", lo, day_after(hi))
              .where(F.col("o_orderpriority").isin(*priorities))
              .select("o_custkey", "o_orderpriority", "o_totalprice"))
    joined = with_customer(orders, src("customer").select("c_custkey", "c_mktsegment"), ["o_orderpriority"])
    return (joined.groupBy("c_mktsegment", "o_orderpriority")
            .agg(F.sum("_orders").alias("orders"),
                 (F.sum("_total") / F.sum("_orders")).cast("decimal(16,6)").alias("avg_price"))
            .orderBy("c_mktsegment", "o_orderpriority"))


def q08(src, custkey: int) -> DataFrame:
    """One customer's orders by date."""
    return (src("orders").where(F.col("o_custkey") == custkey)
            .select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
            .orderBy("o_orderdate", "o_orderkey"))


# ---- ready-made queries ---------------------------------------------------------------------

def n1(src) -> DataFrame:
    """Count and revenue by order priority."""
    return (src("orders").groupBy("o_orderpriority")
            .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
            .orderBy("o_orderpriority"))


def n2(table: ChangeTable, limit: int = 60) -> DataFrame:
    """Versions with the rows that they wrote and deleted."""
    return table.snapshots(limit).select("committed_at", "version", "operation", "rows_written", "rows_deleted")


def n3(table: ChangeTable) -> DataFrame:
    """Data and change files: count, records, average KB."""
    return (content_stats(table_files(table, count_rows=True), records=True)
            .select("content", "files", "records", "avg_kb").orderBy("content"))


def n4(rows: DataFrame, month: str, source: str, limit: int = 50) -> DataFrame:
    """Months with their statistics."""
    return partitions(rows, month, source).orderBy(month).limit(limit)


def n5(batches: DataFrame, hidden: str = "shop.cdc_probe", limit: int = 50) -> DataFrame:
    """Newest writes without the heartbeat table."""
    return (dedup_batches(batches).where(F.col("table_name") != hidden)
            .select("batch_id", "table_name", "kafka_records", "inserts", "updates", "deletes",
                    "merge_ms", "batch_finished_at")
            .orderBy(F.desc("batch_id"), "table_name").limit(limit))


def n6(source: DataFrame, lake: DataFrame) -> DataFrame:
    """Row counts of source and lake."""
    return counts({"source": source, "lake": lake}, "orders").withColumnRenamed("table_name", "side")


def n7(current: DataFrame, pks: list[str], columns: list[str], limit: int = 50) -> DataFrame:
    """Most recently changed rows with their change metadata."""
    return (current.select(*pks, *columns, "_cdc_op", "_cdc_source_ts", "_ingested_at")
            .orderBy(F.desc("_ingested_at"), *pks).limit(limit))


def n8(table: ChangeTable, now: Column | None = None) -> DataFrame:
    """Rows the table had one hour ago."""
    moment = (F.current_timestamp() if now is None else now) - F.expr("INTERVAL 1 HOUR")
    when = table.spark.range(1).select(moment.cast("string").alias("t")).first().t
    return table.as_of(timestamp=when).agg(F.count(F.lit(1)).alias("orders_one_hour_ago"))


def n9(lake: Lake, namespace: str = "shop") -> DataFrame:
    """Tables of the lake."""
    return lake.tables(namespace).orderBy("table_name")


def bounded(df: DataFrame, limit: int = ROW_LIMIT) -> tuple[list, bool]:
    """At most ``limit`` rows for display and whether there are more."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; fields are quoted where needed, NULL is empty."""
    (df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "")
     .option("quote", '"').option("escape", '"').csv(path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
