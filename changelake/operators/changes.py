"""Folding change events into rows.

A *change frame* holds typed rows with ``_cdc_op`` (c, r, u or d) and the order columns
``_cdc_lsn``, ``_offset`` and ``_version``. The newest change of a key decides its state, in
the order (log position, offset, version): the same result however the input was cut into
batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelake.functions.schema import named, quote

# The operations that change rows (create, snapshot read, update, delete).
ROW_OPS = ["c", "r", "u", "d"]
INSERT_OPS = ["c", "r"]
ORDER_COLUMNS = ["_cdc_lsn", "_offset", "_version"]


def change_order(columns: list[str]) -> Column:
    """Comparable position of a change; absent order columns count as 0."""
    return F.struct(*[
        (F.coalesce(F.col(c), F.lit(0)) if c in columns else F.lit(0)).cast("long").alias(c)
        for c in ORDER_COLUMNS])


def latest_per_key(df: DataFrame, pks: list[str], order: Column | None = None) -> DataFrame:
    """The newest change of every key, deletes included.

    An aggregate instead of a window: each task keeps one row per key before the shuffle, so a
    key with any share of the rows sends at most one row per task.
    """
    rest = [c for c in df.columns if c not in pks]
    order = change_order(df.columns) if order is None else order
    newest = df.groupBy(*named(pks)).agg(F.max_by(F.struct(*named(rest)), order).alias("_row"))
    return newest.select(*[named(c) if c in pks else F.col("_row").getField(c).alias(c)
                           for c in df.columns])


def latest_per_key_window(df: DataFrame, pks: list[str], order: Column | None = None) -> DataFrame:
    """Same rows by row_number() = 1, which Spark also limits per key before the shuffle."""
    order = change_order(df.columns) if order is None else order
    w = Window.partitionBy(*named(pks)).orderBy(order.desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def alive(df: DataFrame) -> DataFrame:
    return df.where(F.col("_cdc_op") != "d")


def fold(frames: list[DataFrame], pks: list[str]) -> DataFrame:
    """Rows that remain after applying every change of all frames."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return alive(latest_per_key(union, pks))


def apply_changes(target: DataFrame, changes: DataFrame, pks: list[str]) -> DataFrame:
    """Upsert / delete merge of a change frame into a target with the same columns.

    Matched deletes drop the row, other matched changes replace it, unmatched changes are
    inserted unless they delete. ``changes`` must hold one row per key (``latest_per_key``).
    """
    t, s = target.alias("t"), changes.withColumn("_hit", F.lit(True)).alias("s")
    of = lambda side, c: F.col(f"{side}.{quote(c)}")
    on = [of("t", k) == of("s", k) for k in pks]
    hit = F.col("s._hit").isNotNull()
    cols = [F.when(hit, of("s", c)).otherwise(of("t", c)).alias(c) if c in changes.columns
            else of("t", c) for c in target.columns]
    return (t.join(s, on, "full_outer")
            .where(F.coalesce(F.col("s._cdc_op"), F.lit("")) != "d")
            .select(*cols))


def op_counts(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Changes per operation in one pass: inserts (c + r), updates, deletes."""
    op = F.col("_cdc_op")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(op.isin(INSERT_OPS)).alias("inserts"),
        F.count_if(op == "u").alias("updates"),
        F.count_if(op == "d").alias("deletes"))
