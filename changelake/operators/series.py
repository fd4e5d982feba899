"""Metric series: resampling, rates, deltas and summaries.

A *series frame* has key columns naming the series, ``ts`` and ``value``. Key columns are not
NULL. All functions keep one large series parallel (see ``functions.stats``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelake.functions.scalars import ratio
from changelake.functions.stats import CHUNK_SECONDS, index_rank, join_null_safe, look_back, order_statistics, running

# Sampling step, how long a sample stays valid, delta and clipping parameters.
STEP_SECONDS, LOOKBACK_SECONDS = 15, 300
DELTA_SECONDS = 300
CLIP_SERIES, CLIP_BATCHES = (8.0, 2.0), (4.0, 2.2)
TRAILING_SECONDS = 10


def seconds_of(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / 1_000_000


def micros_of(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def label_key(labels: Column, ignoring: tuple[str, ...] = ()) -> Column:
    """Canonical text of a label map, optionally without some labels."""
    kept = F.map_filter(labels, lambda k, _: ~k.isin(*ignoring)) if ignoring else labels
    pairs = F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ",")


def resample(df: DataFrame, keys: list[str], step: int = STEP_SECONDS, lookback: int = LOOKBACK_SECONDS,
             chunk_seconds: int = 86_400, recorded: str | None = None) -> DataFrame:
    """Value at every step: the newest sample up to it, at most ``lookback`` seconds old. Of samples at one
    instant the first by the number ``recorded`` counts, without such a column the one of largest value.

    Each sample is carried to the steps before the next sample, so the work grows with the
    output and a series is never collected in one place.
    """
    width = step * 1_000_000
    # the first step at or after each sample; of several samples before a step the newest wins
    slot = (F.ceil(micros_of("ts") / F.lit(width)) * width).cast("long")
    order = F.struct("ts", F.col("value") if recorded is None else -F.col(recorded))
    newest = (df.withColumn("_slot", slot).groupBy(*keys, "_slot")
              .agg(F.max_by(F.struct("ts", "value"), order).alias("_s"))
              .withColumn("_us", micros_of("_s.ts")).withColumn("_back", -F.col("_slot")))
    ahead = running(newest, keys, ["_back"], F.floor(F.col("_back") / F.lit(chunk_seconds * 1_000_000)),
                    F.col("_slot"), "_next", "last", inclusive=False)
    last_valid = F.floor((F.col("_us") + lookback * 1_000_000) / F.lit(width)) * width
    until = F.least(last_valid, F.coalesce(F.col("_next") - width, last_valid)).cast("long")
    steps = F.explode(F.sequence(F.col("_slot"), F.greatest(until, F.col("_slot")), F.lit(width).cast("long")))
    return (ahead.select(*keys, "_slot", "_us", "_s", until.alias("_until"), steps.alias("_at"))
            .where(F.col("_at") <= F.col("_until"))
            .select(*keys, F.timestamp_micros("_at").alias("ts"), F.col("_s.value").alias("value")))


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest value per series."""
    return df.groupBy(*keys).agg(F.max("ts").alias("ts"),
                                 F.max_by("value", F.struct("ts", "value")).alias("value"))


def label_sum(df: DataFrame, keys: list[str], hidden: Column | None = None) -> DataFrame:
    """Sum of the newest values of all series that the filter does not hide."""
    now = latest(df, keys)
    return (now if hidden is None else now.where(~hidden)).agg(F.sum("value").alias("total"))


def counter_rate(df: DataFrame, keys: list[str], order: list[str], window_seconds: int = 120,
                 chunk_seconds: int | None = None) -> DataFrame:
    """Increase of a counter per second in windows of the given length.

    A value below its predecessor means the counter restarted: it counts from zero.
    """
    chunk_seconds = chunk_seconds or CHUNK_SECONDS
    chunk = F.floor(micros_of("ts") / F.lit(chunk_seconds * 1_000_000))
    with_prev = running(df, keys, order, chunk, F.col("value"), "_prev", "last", inclusive=False)
    grown = F.when(F.col("value") < F.col("_prev"), F.col("value")) \
             .otherwise(F.col("value") - F.col("_prev"))
    slot = F.timestamp_micros((F.floor(micros_of("ts") / F.lit(window_seconds * 1_000_000))
                               * (window_seconds * 1_000_000)).cast("long"))
    return (with_prev.withColumn("_up", grown).groupBy(*keys, slot.alias("window_start"))
            .agg(F.coalesce(F.sum("_up"), F.lit(0)).alias("increase"))
            .withColumn("rate", F.col("increase") / float(window_seconds)))


def delta(df: DataFrame, keys: list[str], window: int = DELTA_SECONDS) -> DataFrame:
    """Newest value against the newest sample at least ``window`` seconds older.

    Without such a sample the first one counts; less than half a window apart gives NULL.
    """
    order = F.struct("ts", "value")
    us, width = micros_of("ts"), CHUNK_SECONDS * 1_000_000
    placed = df.withColumn("_chunk", F.floor(us / F.lit(width)))
    chunks = placed.groupBy(*keys, "_chunk").agg(F.max(order).alias("_newest"), F.min(order).alias("_oldest"))
    ends = chunks.groupBy(*keys).agg(F.max("_newest").alias("_end"), F.min("_oldest").alias("_first"))
    limit = ends.withColumn("_limit", F.col("_end.ts") - F.expr(f"INTERVAL {window} SECONDS"))
    limit = limit.withColumn("_chunk", F.floor(F.unix_micros(F.col("_limit").cast("timestamp")) / F.lit(width)))
    # chunks before the limit's are settled by their newest sample; only the limit's own chunk is read by rows
    inside = join_null_safe(placed, limit.select(*keys, "_chunk", "_limit"), [*keys, "_chunk"]).where("ts <= _limit")
    whole = join_null_safe(chunks, limit.select(*keys, F.col("_chunk").alias("_cut")), keys).where("_chunk < _cut")
    old = inside.select(*keys, order.alias("_o")).unionByName(whole.select(*keys, F.col("_newest").alias("_o")))
    old = old.groupBy(*keys).agg(F.max("_o").alias("_old"))
    ref = join_null_safe(ends, old, keys, "left").select(
        *keys, F.col("_end.ts").alias("_last"), F.col("_end.value").alias("now"), "_old", "_first")
    base = F.coalesce("_old", "_first")
    far = (F.unix_micros(F.col("_last").cast("timestamp"))
           - F.unix_micros(base["ts"].cast("timestamp"))) >= window * 500_000
    return ref.select(*keys, "now", F.when(far, base["value"]).alias("before"),
                      F.when(far, F.col("now") - base["value"]).alias("abs"))


def trailing_rate(df: DataFrame, keys: list[str], total: str, seconds: int = TRAILING_SECONDS) -> DataFrame:
    """Growth of a running total per second over the trailing window of each sample.

    The span runs from the oldest sample inside the window; below one second the rate is 0.
    """
    seen = look_back(df.select(*keys, "ts", total), keys, "ts", seconds, F.struct("ts", total), "_first")
    span = seconds_of("ts") - seconds_of("_first.ts")
    rate = ratio(F.col(total) - F.col(f"_first.{total}"), span)
    return seen.select(*keys, "ts", total, F.when(span >= 1, rate).otherwise(F.lit(0.0)).alias("rate"))


def series_summary(df: DataFrame, keys: list[str], clip: tuple[float, float] = CLIP_SERIES) -> DataFrame:
    """Median, p90, max and the upper bound to show: a lone outlier must not set the scale."""
    stats = order_statistics(df, keys, "value", {"median": index_rank(0.5), "p90": index_rank(0.9)})
    clipped = (F.col("p90") > 0) & (F.col("max") > F.col("p90") * clip[0])
    return stats.select(*keys, "n", "median", "p90", "max", clipped.alias("clipped"),
                        F.when(clipped, F.col("p90") * clip[1]).otherwise(F.col("max")).alias("shown_max"))


def change_points(df: DataFrame, keys: list[str], order: list[str], value: str,
                  chunk: Column) -> DataFrame:
    """Rows whose value differs (null-safe) from the previous row of their series."""
    wrapped = F.struct(F.col(value).alias("v"))  # a NULL value is a value here
    prev = running(df, keys, order, chunk, wrapped, "_prev", "last", inclusive=False)
    return prev.where(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(value))).drop("_prev")
