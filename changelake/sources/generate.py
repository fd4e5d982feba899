"""Changes derived from existing tables: a fixed change log, and samples of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages of the derived change log.
STAGE_OFFSET = 10_000_000
REINSERT_SHIFT = 1_000_000


def derived_changes(orders: DataFrame) -> DataFrame:
    """A typed change log of orders in four stages (= versions), by arithmetic on the keys.

    0 snapshot of all rows; 1 price + 10 where key % 3 = 0; 2 delete where key % 10 = 0;
    3 re-insert under key + 1,000,000 where key % 7 = 0.
    """
    key, price = F.col("o_orderkey"), F.col("o_totalprice")

    # one pass over the orders: each row becomes the list of its changes
    def change(stage: int, op: str, new_key: Column, new_price: Column) -> Column:
        offset = F.lit(stage * STAGE_OFFSET) + key
        return F.struct(new_key.alias("o_orderkey"), new_price.cast("decimal(12,2)").alias("o_totalprice"),
                        F.lit(op).alias("_cdc_op"), F.lit(stage).cast("long").alias("_version"),
                        offset.alias("_offset"), offset.alias("_cdc_lsn"))

    steps = F.array_compact(F.array(
        change(0, "r", key, price),
        F.when(key % 3 == 0, change(1, "u", key, price + 10)),
        F.when(key % 10 == 0, change(2, "d", key, price)),
        F.when(key % 7 == 0, change(3, "c", key + REINSERT_SHIFT, price))))
    rest = [c for c in orders.columns if c not in ("o_orderkey", "o_totalprice")]
    data = [F.col(f"s.{c}") if c not in rest else F.col(c) for c in orders.columns]
    return (orders.select(*rest, F.explode(steps).alias("s"))
            .select(*data, "s._cdc_op", "s._cdc_lsn", "s._offset", "s._version"))


def sample_keys(df: DataFrame, pk: str, n: int = 200, seed: int = 0) -> DataFrame:
    """A random sample of existing keys; a small table falls back to one random row."""
    some = df.select(pk).sample(fraction=0.01, seed=seed).limit(n)
    return some if some.take(1) else df.select(pk).orderBy(F.rand(seed)).limit(1)


def erasure_candidates(customers: DataFrame, orders: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """Customers that own orders, drawn from the orders so that both tables hold their data."""
    def owners(some_orders: DataFrame) -> DataFrame:
        keys = some_orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
        return customers.join(keys, "c_custkey", "left_semi").select("c_custkey")

    some = owners(orders.sample(fraction=0.01, seed=seed)).limit(n)
    if some.take(1):
        return some
    owned = owners(orders).orderBy(F.rand(seed)).limit(1)
    return owned if owned.take(1) else customers.select("c_custkey").orderBy(F.rand(seed)).limit(1)
