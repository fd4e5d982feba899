"""Time travel on change frames: past states, row history, differences, erasure.

All functions are plain DataFrame transformations of a change frame with a ``_version``
column; ``lake.ChangeTable`` calls them with the files of the right versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelake.functions.scalars import same_value
from changelake.functions.schema import META, named
from changelake.operators.changes import alive, change_order, latest_per_key


def as_of(changes: DataFrame, pks: list[str], version: Column | int) -> DataFrame:
    """State after all changes up to and including a version."""
    return alive(latest_per_key(changes.where(F.col("_version") <= version), pks))


def version_at(commits: DataFrame, timestamp: Column) -> Column:
    """Scalar: newest version committed at or before a time."""
    return commits.where(F.col("committed_at") <= timestamp).select(F.max("version")).scalar()


def changed_since(current: DataFrame, version: Column | int) -> DataFrame:
    """Current rows per operation whose last change came after a version."""
    return (current.where(F.col("_version") > version)
            .groupBy("_cdc_op").agg(F.count(F.lit(1)).alias("rows_changed")))


def data_columns(df: DataFrame, pks: list[str]) -> list[str]:
    return [c for c in df.columns if not c.startswith("_") and c not in pks]


def changed_column_names(df: DataFrame, old: str, new: str, columns: list[str]) -> Column:
    """Names of the columns whose values differ (null-safe) between two row structs."""
    return F.array_compact(F.array(*[
        F.when(~F.col(old).getField(c).eqNullSafe(F.col(new).getField(c)), F.lit(c)) for c in columns]))


def diff(changes: DataFrame, pks: list[str], older: int, newer: int) -> DataFrame:
    """Rows that differ between two versions, with the kind of change and the changed columns.

    Both states come from one aggregation: each key keeps its newest row up to either version.
    """
    cols = data_columns(changes, pks)
    order = change_order(changes.columns)
    state = F.struct("_cdc_op", *named(cols))
    upto = lambda v: F.max_by(state, F.when(F.col("_version") <= v, order))
    both = changes.where(F.col("_version") <= newer).groupBy(*named(pks)).agg(
        upto(older).alias("old"), upto(newer).alias("new"), F.max("_version").alias("_last"))
    live = lambda s: F.col(s).isNotNull() & (F.col(f"{s}._cdc_op") != "d")
    kind = (F.when(live("old") & ~live("new"), "deleted")
            .when(~live("old") & live("new"), "inserted")
            .when(live("old") & live("new"), "updated"))
    names = F.when(F.col("change") == "updated", changed_column_names(both, "old", "new", cols)) \
             .otherwise(F.array().cast("array<string>"))
    return (both.where(F.col("_last") > older)
            .withColumn("change", kind)
            .withColumn("changed_columns", names)
            .where(F.col("change").isNotNull()
                   & ((F.col("change") != "updated") | (F.size("changed_columns") > 0)))
            .select(*named(pks), "change", "changed_columns",
                    F.when(live("old"), F.col("old")).alias("old"),
                    F.when(live("new"), F.col("new")).alias("new")))


def except_rows(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, as a set or as a bag."""
    return a.exceptAll(b) if keep_duplicates else a.subtract(b)


def intervals(changes: DataFrame, pks: list[str], versions: list[int]) -> DataFrame:
    """Validity intervals: per key and state the listed versions it was valid from and to (exclusive, NULL while
    it lasts), the row (NULL once deleted), and whether it is the key's first.

    Each change counts for the oldest listed version that includes it, so a key sends at most one row per
    listed version to the ordered pass. A late change that is older than what it meets opens no interval.
    """
    marks = F.array(*[F.lit(int(v)).cast("long") for v in sorted(versions)])
    cols = [c for c in changes.columns if c not in [*pks, "_version"]]
    order = change_order(changes.columns)
    slot = F.try_element_at(F.filter(marks, lambda m: m >= F.col("_version")), F.lit(1))
    at_mark = (changes.withColumn("_mark", slot).where(F.col("_mark").isNotNull())
               .groupBy(*named([*pks, "_mark"])).agg(F.max_by(F.struct("_version", *named(cols)), order).alias("_row"),
                                                     F.max(order).alias("_ord")))
    w = Window.partitionBy(*named(pks)).orderBy("_mark")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max("_ord").over(so_far)
    moved = (at_mark.withColumns({"_best": best, "_before": F.max("_ord").over(w.rowsBetween(Window.unboundedPreceding, -1))})
             .where(F.col("_before").isNull() | (F.col("_best") > F.col("_before"))))
    live = F.when(F.col("_row._cdc_op") != "d", F.col("_row"))
    return moved.select(*named(pks), F.col("_mark").alias("valid_from"), F.lead("_mark").over(w).alias("valid_to"),
                        live.alias("row"), F.col("_before").isNull().alias("first"))


def row_history(changes: DataFrame, pks: list[str], versions: list[int]) -> DataFrame:
    """The row of every key at each of the given versions (NULL where absent): the versions that lie in its
    validity intervals, and those before its first one."""
    marks = F.array(*[F.lit(int(v)).cast("long") for v in sorted(versions)])
    found = intervals(changes, pks, versions)
    inside = F.filter(marks, lambda m: (F.col("first") | (m >= F.col("valid_from")))
                      & (F.col("valid_to").isNull() | (m < F.col("valid_to"))))
    return found.select(*named(pks), F.explode(inside).alias("version"), "valid_from", "row").select(
        *named(pks), "version", F.when(F.col("version") >= F.col("valid_from"), F.col("row")).alias("row"))


def history_changes(history: DataFrame, pks: list[str], compared: list[str] | None = None) -> DataFrame:
    """Row history with the columns that differ from the next older version.

    ``compared``: the columns that can make a row that stays an updated one, all by default. A row that appears
    has all its columns changed.
    ``history`` is the bounded output of ``row_history`` (a few versions per key).
    """
    fields = [f.name for f in history.schema["row"].dataType if not f.name.startswith("_")]
    w = Window.partitionBy(*pks).orderBy("version")
    prev = history.withColumn("_prev", F.lag("row").over(w)) \
                  .withColumn("_rank", F.row_number().over(w))
    names = changed_column_names(prev, "_prev", "row", fields if compared is None else compared)
    appeared = F.col("_prev").isNull() & F.col("row").isNotNull()
    vanished = F.col("_prev").isNotNull() & F.col("row").isNull()
    changed = F.when(F.col("_rank") == 1, F.array().cast("array<string>")) \
               .when(appeared, F.array(*[F.lit(c) for c in fields])) \
               .when(vanished, F.array().cast("array<string>")).otherwise(names)
    return (prev.withColumn("changed_columns", changed)
            .withColumn("is_change", (F.col("_rank") > 1)
                        & (appeared | vanished | (F.size("changed_columns") > 0)))
            .drop("_prev", "_rank"))


def erase_changes(rows: DataFrame, pks: list[str], lsn: Column, source_ts: Column) -> DataFrame:
    """Delete changes for the given rows: keys kept, every other data column NULL."""
    out = []
    for f in rows.schema:
        if f.name in pks:
            out.append(named(f.name))
        elif f.name not in META and not f.name.startswith("_"):
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return rows.select(*out, F.lit("d").alias("_cdc_op"), source_ts.alias("_cdc_source_ts"),
                       lsn.cast("long").alias("_cdc_lsn"),
                       F.current_timestamp().alias("_ingested_at"))


def subject_summary(orders: DataFrame, owner: str, key, amount: str) -> DataFrame:
    """Number and total of one subject's rows; a subject without rows totals 0."""
    return orders.where(F.col(owner) == key).agg(
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum(amount), F.lit(0)).alias("order_total"))


def row_compare(source: DataFrame, lake: DataFrame, pks: list[str]) -> DataFrame:
    """Source and lake value of every column side by side, one output row per key and column."""
    types_s = {f.name: f.dataType for f in source.schema}
    types_l = {f.name: f.dataType for f in lake.schema}
    names = [*types_s, *[n for n in types_l if n not in types_s]]
    s = source.withColumn("_in_source", F.lit(True)).alias("s")
    t = lake.withColumn("_in_lake", F.lit(True)).alias("t")
    joined = s.join(t, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in pks], "full_outer")

    def cell(name: str) -> Column:
        a = F.col(f"s.{name}") if name in types_s else F.lit(None).cast("string")
        b = F.col(f"t.{name}") if name in types_l else F.lit(None).cast("string")
        eq = same_value(a, b, types_s[name], types_l[name]) \
            if name in types_s and name in types_l else F.lit(None).cast("boolean")
        return F.struct(F.lit(name).alias("column"), a.cast("string").alias("source"),
                        b.cast("string").alias("lake"), F.lit(name in META).alias("is_meta"),
                        eq.alias("equal"))

    keys = [F.coalesce(F.col(f"s.{k}"), F.col(f"t.{k}")).alias(k) for k in pks]
    return (joined.select(*keys, F.explode(F.array(*[cell(n) for n in names])).alias("c"))
            .select(*pks, "c.*"))


def presence(source: DataFrame, lake: DataFrame, keys: DataFrame, pks: list[str]) -> DataFrame:
    """For requested keys: on both sides, on one side, or gone from both."""
    s = source.select(*pks, F.lit(True).alias("in_source"))
    t = lake.select(*pks, F.lit(True).alias("in_lake"))
    return (keys.select(*pks).distinct().join(s, pks, "left").join(t, pks, "left")
            .select(*pks, F.coalesce("in_source", F.lit(False)).alias("in_source"),
                    F.coalesce("in_lake", F.lit(False)).alias("in_lake")))


def null_gap(df: DataFrame, column: str) -> DataFrame:
    """How many rows do not carry a later added column yet."""
    return df.groupBy(F.col(column).isNull().alias("missing")).agg(F.count(F.lit(1)).alias("rows"))
