"""Exact order statistics and running values that stay parallel inside one large group.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends a whole series to one task. The
functions here cut each group into chunks of its ordering axis (an hour, a value range), work
on all chunks in parallel and pass only one summary row per chunk from chunk to chunk, so one
group may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelake.session import is_small, shared_dir

def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column,
            out: str, kind: str = "last", inclusive: bool = True, total: str | None = None) -> DataFrame:
    """Running ``last`` (non-null), ``min``, ``max`` or ``sum`` of ``value`` per key.

    ``order`` are ascending columns; ``chunk`` must not decrease along them. With
    ``inclusive=False`` the current row does not count (``last`` is then a lag). ``total`` names
    a further column with the value over the whole series. A NULL key is a series like any other.
    """
    over_rows = {
        "last": lambda c: F.last(c, ignorenulls=True),
        "min": F.min, "max": F.max, "sum": F.sum,
    }[kind]
    tail = F.struct(*order)
    summary = F.max_by("_value", F.when(F.col("_value").isNotNull(), tail)) if kind == "last" \
        else over_rows(F.col("_value"))

    # rows without an order value sort first and so belong to the first chunk
    place = F.coalesce(chunk.cast("long"), F.lit(-(2**62)))
    src = df.withColumn("_chunk", place).withColumn("_value", value)
    parts = src.groupBy(*keys, "_chunk").agg(summary.alias("_part"))
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = [over_rows(F.col("_part")).over(Window.partitionBy(*keys)).alias(total)] if total else []
    carried = parts.select(*keys, "_chunk", over_rows(F.col("_part")).over(before).alias("_carry"), *whole)

    within = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = src.withColumn("_local", over_rows(F.col("_value")).over(within))
    both = join_null_safe(local, carried, [*keys, "_chunk"])
    combined = {
        "last": F.coalesce("_local", "_carry"),
        "min": F.least("_local", "_carry"),
        "max": F.greatest("_local", "_carry"),
        "sum": F.when(F.col("_local").isNull(), F.col("_carry"))
                .otherwise(F.col("_local") + F.coalesce("_carry", F.col("_local") * 0)),
    }[kind]
    return both.select(*[F.col(c) for c in df.columns], combined.alias(out),
                       *([total] if total else []))


# Length of the chunks that a time axis is cut into. Results do not depend on it; a series with more than
# some 1,000 rows a second may want shorter ones, which callers can give.
CHUNK_SECONDS = 600


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys match; the right side's keys are left out."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, on), how).drop(*[f"_right_{k}" for k in keys])


def look_back(df: DataFrame, keys: list[str], ts: str, seconds: int, row: Column, out: str) -> DataFrame:
    """For each row the oldest ``row`` (a struct; of several at one time the smallest) that is at most ``seconds``
    older; the row itself at least.

    Rows and a mark for each, ``seconds`` before it, lie on one axis that is read backwards in time, and a mark
    takes the last row met: two entries a row, however many rows a window holds.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    entry = lambda at, mark: df.select(
        *df.columns, (-at).alias("_back"), F.lit(mark).alias("_mark"), (F.lit(None) if mark else row).alias("_row"))
    kind = df.select(row.alias("r")).schema["r"].dataType
    axis = entry(micros, False).unionByName(entry(micros - seconds * 1_000_000, True).withColumn("_row", F.col("_row").cast(kind)))
    # at the same time rows come first, the largest of them first, so that the smallest is met last
    axis = axis.withColumn("_turn", F.when(F.col("_mark"), None).otherwise(F.row_number().over(
        Window.partitionBy(*keys, "_back", "_mark").orderBy(F.col("_row").desc()))))
    axis = axis.withColumn("_turn", F.coalesce("_turn", F.lit(2**31 - 1)))
    met = running(axis, keys, ["_back", "_turn"], F.floor(F.col("_back") / F.lit(CHUNK_SECONDS * 1_000_000)),
                  F.col("_row"), out, "last")
    return met.where("_mark").select(*df.columns, out)


# Ranges that a group is cut into at a time, and rows of a range that one task may sort.
SPLITTERS = 128
RANGE_ROWS = 1_000_000


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact values at 1-based ranks per group; ranks are expressions over the group size ``n``.
    Returns keys, n, min, max and one column per rank.

    Distributed selection. Splitters drawn from the data (approximate quantiles, merged before the shuffle)
    cut a group into ranges of about equal size; rows are only counted per range, and just the ranges that
    hold a wanted rank go on, until none has more than RANGE_ROWS. A splitter's own value is a range of its
    own, so repeated values end there. Each round keeps about a 128th of the rows, whatever their
    distribution; the last step adds up equal values before it sorts them.
    """
    # zero, but not a literal: joins on a literal would pair rows without a key
    zero = (F.spark_partition_id() * 0).cast("long")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), zero.alias("_range"))
    by = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.col("_range"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    wanted = sizes.select(*by, zero.alias("_range"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("long").alias("k")) for name, rank in ranks.items()])).alias("_t")).select(
        *by, "_range", F.col("_t.name").alias("_name"), F.col("_t.k").alias("_k"))
    solved = []
    while True:
        group = [*by, "_range"]
        largest = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
        if largest is None or largest <= RANGE_ROWS:
            break
        shares = [i / SPLITTERS for i in range(1, SPLITTERS)]
        splits = written(rows.groupBy(*group).agg(F.array_distinct(F.percentile_approx("_v", shares)).alias("_splits")), "splitters")
        met = join_null_safe(rows, F.broadcast(splits) if is_small(splits) else splits, group)
        below = F.size(F.filter("_splits", lambda s: s < F.col("_v")))
        part = (2 * below + F.array_contains("_splits", F.col("_v")).cast("int")).cast("long")
        labelled = met.withColumn("_part", part)
        counts = labelled.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*group).orderBy("_part")      # at most 2 * SPLITTERS rows
        counts = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_before", F.col("_upto") - F.col("_c"))
        placed = join_null_safe(wanted, counts, group).where(
            (F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_upto")))
        placed = written(placed.select(*by, "_range", "_part", "_name", (F.col("_k") - F.col("_before")).alias("_k")), "ranks")
        found = join_null_safe(placed.where("_part % 2 = 1"), splits, group)
        solved.append(found.select(*by, "_name", F.get("_splits", (F.col("_part") / 2).cast("int")).alias("_at")))
        below_one = lambda d: d.withColumn("_range", F.col("_range") * (2 * SPLITTERS + 1) + F.col("_part"))
        open_ = placed.where("_part % 2 = 0")
        held = open_.select(*group, "_part").distinct().withColumn("_open", F.lit(True))
        going = join_null_safe(labelled, F.broadcast(held) if is_small(held) else held, [*group, "_part"])
        rows = written(below_one(going).select(*by, "_v", "_range"), "ranges")
        wanted = below_one(open_).select(*by, "_range", "_name", "_k")
    hist = rows.groupBy(*by, "_range", "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = hist.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy("_v")))
    here = join_null_safe(cum, wanted, [*by, "_range"]).where("_cum >= _k").groupBy(*by, "_name").agg(F.min("_v").alias("_at"))
    values = reduce(lambda a, b: a.unionByName(b), [*solved, here.select(*by, "_name", "_at")])
    picked = values.groupBy(*by).agg(*[F.min(F.when(F.col("_name") == name, F.col("_at"))).alias(name) for name in ranks])
    out = join_null_safe(sizes, picked, by).select(*by, "n", "min", "max", *ranks)
    return out if keys else out.drop("_all")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once to the shared folder and read from there."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest_rank(p: float) -> Column:
    """Rank ceil(p * n), at least 1 (the nearest-rank percentile)."""
    return F.greatest(F.ceil(F.lit(p).cast("decimal(6,4)") * F.col("n")), F.lit(1))


def index_rank(p: float) -> Column:
    """Rank of the element at 0-based index floor(p * n) of the sorted values."""
    return F.least(F.floor(F.lit(p).cast("decimal(6,4)") * F.col("n")) + 1, F.col("n"))


def medians(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Interpolating median per group: the mean of the two middle values."""
    mid = order_statistics(df, keys, value, {
        "_lo": F.floor((F.col("n") + 1) / 2), "_hi": F.floor(F.col("n") / 2) + 1})
    return mid.withColumn(out, (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi")


def combine_rows(a: DataFrame, b: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Columns of two frames with one row per key (or one row each) side by side, without a join."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])
