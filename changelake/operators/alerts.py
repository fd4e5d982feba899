"""Alert rules with a hold time, evaluated over metric series on a common time grid.

A rule is active for a label set at a step when its condition holds there; it is *pending*
from the first active step and *firing* once it has been active for the hold time without a
gap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelake.functions.stats import running
from changelake.operators.series import LOOKBACK_SECONDS, STEP_SECONDS, label_key, resample
from changelake.session import shared_dir

MB = 1024 * 1024


def written_once(df: DataFrame, by: str) -> DataFrame:
    """The frame as a table in the shared folder, split by a column: every rule reads its part
    instead of resampling again."""
    path = shared_dir(df.sparkSession, "grid")
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


class Grid:
    """Series resampled to the grid: metric, labels, ts, value."""

    def __init__(self, series: DataFrame, step: int = STEP_SECONDS, lookback: int = LOOKBACK_SECONDS):
        self.step = step
        named = series.withColumn("_key", label_key(F.col("labels")))
        names = named.groupBy("metric", "_key").agg(F.any_value("labels").alias("labels"))
        samples = resample(named.select("metric", "_key", "ts", "value"), ["metric", "_key"],
                           step, lookback).join(names, ["metric", "_key"])
        self.samples = written_once(samples, "metric")

    def where(self, metric: str, condition: Column) -> DataFrame:
        """Steps at which a metric meets a condition: labels, ts."""
        return (self.samples.where((F.col("metric") == metric) & condition)
                .select(F.col("labels"), F.col("_key").alias("label_key"), "ts"))

    def absent(self, metric: str) -> DataFrame:
        """Steps at which a metric has no sample although others do."""
        steps = self.samples.select("ts").distinct()
        present = self.samples.where(F.col("metric") == metric).select("ts").distinct()
        return steps.join(present, "ts", "left_anti").select(
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("labels"),
            F.lit("").alias("label_key"), "ts")


def both(left: DataFrame, right: DataFrame, on_labels: bool = True, ignoring: tuple[str, ...] = ()) -> DataFrame:
    """Steps of ``left`` at which ``right`` holds too, for the same labels or for any."""
    if not on_labels:
        return left.join(right.select("ts").distinct(), "ts", "left_semi").select(*left.columns)
    match = lambda d: d.withColumn("_m", label_key(F.col("labels"), ignoring))
    return (match(left).join(match(right).select("_m", "ts").distinct(), ["_m", "ts"], "left_semi")
            .select(*left.columns))


@dataclass(frozen=True)
class Rule:
    name: str
    hold_seconds: int
    summary: str
    active: Callable[[Grid], DataFrame]


# The standard rules with their thresholds and hold times.
RULES = [
    Rule("CdcFreshnessHigh", 120, "the lake is more than 2 minutes behind the source",
         lambda g: g.where("lakehouse_cdc_freshness_seconds", F.col("value") > 120)),
    Rule("DebeziumConnectorDown", 60, "the connector or one of its tasks is not running",
         lambda g: g.where("lakehouse_connector_running", F.col("value") == 0)
         .unionByName(g.absent("lakehouse_connector_running"))),
    Rule("ReplicationSlotLagHigh", 300, "more than 512 MB of log wait for the connector",
         lambda g: g.where("lakehouse_replication_slot_lag_bytes", F.col("value") > 512 * MB)),
    Rule("SmallFilesAccumulating", 600, "many small data files: compaction is due",
         lambda g: both(g.where("lakehouse_iceberg_files",
                                (F.col("value") > 500) & (F.col("labels")["content"] == "data")),
                        g.where("lakehouse_iceberg_avg_data_file_bytes", F.col("value") < 8 * MB),
                        ignoring=("content",))),
    Rule("StreamingStalled", 120, "no batch for 10 minutes while changes are pending",
         lambda g: both(g.where("lakehouse_ingest_last_batch_age_seconds", F.col("value") > 600),
                        g.where("lakehouse_replication_slot_lag_bytes", F.col("value") > 10 * MB),
                        on_labels=False)),
]
STATE_RANK = {"firing": 0, "pending": 1, "inactive": 2}


def hold(active: DataFrame, keys: list[str], step: int, hold_seconds: Column,
         chunk_seconds: int = 86_400) -> DataFrame:
    """Active steps with the start of their gap-free run and the resulting state."""
    chunk = F.floor(F.unix_micros("ts") / F.lit(chunk_seconds * 1_000_000))
    prev = running(active, keys, ["ts"], chunk, F.col("ts"), "_prev", "last", inclusive=False)
    starts = F.col("_prev").isNull() | (F.col("_prev") < F.col("ts") - F.expr(f"INTERVAL {step} SECONDS"))
    runs = running(prev, keys, ["ts"], chunk, F.when(starts, F.col("ts")), "since", "last")
    held = F.timestamp_diff("SECOND", F.col("since"), F.col("ts"))
    return runs.drop("_prev").withColumn(
        "state", F.when(held >= hold_seconds, "firing").otherwise("pending"))


def alert_history(series: DataFrame, rules: list[Rule] = RULES, step: int = STEP_SECONDS,
                  lookback: int = LOOKBACK_SECONDS) -> DataFrame:
    """State of every active rule and label set at every step."""
    grid, parts = Grid(series, step, lookback), []
    for rule in rules:
        parts.append(rule.active(grid).select(
            F.lit(rule.name).alias("rule"), F.lit(rule.hold_seconds).alias("_hold"), "label_key", "ts").distinct())
    active = parts[0]
    for p in parts[1:]:
        active = active.unionByName(p)
    return hold(active, ["rule", "label_key"], step, F.col("_hold")).drop("_hold")


def rule_states(history: DataFrame, rules: list[Rule], at: Column) -> DataFrame:
    """Every rule at one time, the worst label set first: firing, pending, inactive, then name."""
    spark = history.sparkSession
    listed = spark.createDataFrame([(r.name, r.hold_seconds, r.summary) for r in rules],
                                   "rule string, hold_seconds int, summary string")
    rank = F.when(F.col("state") == "firing", 0).otherwise(1)
    now = history.where(F.col("ts") == at).groupBy("rule").agg(
        F.min(rank).alias("_rank"), F.min("since").alias("since"))
    order = F.coalesce("_rank", F.lit(STATE_RANK["inactive"]))
    name = F.element_at(F.array(*[F.lit(s) for s in STATE_RANK]), order + 1)
    return (listed.join(now, "rule", "left").withColumn("state", name)
            .orderBy(order, "rule").select("rule", "state", "since", "hold_seconds", "summary"))
