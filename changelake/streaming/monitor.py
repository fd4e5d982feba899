"""Live pipeline signals as streaming queries: freshness, rates, probes and alerts.

All inputs carry an event time with a watermark, so state is bounded by the window or bound
that each function names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from changelake.operators.metrics import PROBE_TIMEOUT_SECONDS
from changelake.operators.series import TRAILING_SECONDS


def live_freshness(probes: DataFrame, window: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """Newest heartbeat the lake shows, per window of its arrival (``seen_at``)."""
    return (probes.withWatermark("seen_at", delay).groupBy(F.window("seen_at", window))
            .agg(F.max("created_at").alias("newest"), F.max("seen_at").alias("_seen"))
            .select(F.col("window.end").alias("window_end"), "newest",
                    (F.timestamp_diff("MILLISECOND", F.col("newest"), F.col("_seen")) / 1000.0)
                    .alias("freshness_s")))


def live_ingest_rate(batches: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                     delay: str = "1 hour") -> DataFrame:
    """Records per second and batches in a sliding window over batch ends.

    A replayed batch is dropped by its id before it is counted.
    """
    once = (batches.withWatermark("batch_finished_at", delay)
            .dropDuplicatesWithinWatermark(["batch_id", "table_name"]))
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return (once.groupBy(F.window("batch_finished_at", window, slide))
            .agg(F.sum("kafka_records").alias("records"),
                 F.approx_count_distinct("batch_id").alias("batches"))
            .select("window.start", "window.end", "records", "batches",
                    (F.col("records") / seconds).alias("records_per_sec")))


def live_trailing_rate(operations: DataFrame, delay: str = "30 seconds",
                       seconds: int = TRAILING_SECONDS) -> DataFrame:
    """Completed operations per second over the trailing seconds, every second."""
    return (operations.withWatermark("ts", delay)
            .groupBy(F.window("ts", f"{seconds} seconds", "1 second"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .select(F.col("window.end").alias("ts"), (F.col("_n") / float(seconds)).alias("rate")))


def live_probe_match(sent: DataFrame, visible: DataFrame,
                     timeout_seconds: int = PROBE_TIMEOUT_SECONDS) -> DataFrame:
    """Probes with their latency; unmatched ones appear with NULL once the timeout has passed."""
    s = sent.withWatermark("sent_at", "10 seconds").alias("s")
    v = visible.withWatermark("visible_at", "10 seconds").alias("v")
    bound = F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    on = ((F.col("s.probe_id") == F.col("v.probe_id")) & (F.col("v.visible_at") >= F.col("s.sent_at"))
          & (F.col("v.visible_at") <= F.col("s.sent_at") + bound))
    return (s.join(v, on, "left_outer")
            .select("s.probe_id", "s.sent_at", "v.visible_at",
                    F.timestamp_diff("MILLISECOND", F.col("s.sent_at"), F.col("v.visible_at"))
                    .alias("latency_ms")))


ALERT_OUTPUT = T.StructType([
    T.StructField("rule", T.StringType()), T.StructField("label_key", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("since", T.TimestampType()),
    T.StructField("state", T.StringType())])


MICROS = 1_000_000


class HoldProcessor(StatefulProcessor):
    """One rule and label set, in event time.

    ``waiting``: evaluated steps that the watermark has not reached, by time; a step that is sent twice is one.
    ``run``: since when the condition has held without a gap, its last step and the time of the next timer. A
    timer at the earliest waiting step settles every step up to the watermark in time order, however they
    arrived. A label set that is not heard of for a step is resolved by a second timer, and its state ends.
    """

    def __init__(self, step_seconds: int):
        self.step = step_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "active boolean, hold long")
        self.run = handle.getValueState("run", "since long, last long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            for ts, active, hold in zip(at, frame["active"], frame["hold_seconds"]):
                self.waiting.updateValue((int(ts),), (bool(active), int(hold)))
                earliest = ts if earliest is None else min(earliest, ts)
        if earliest is not None:
            since, last, timer = self._held()
            self._remind(since, last, timer, int(earliest))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        since, last, _ = self._held()
        steps = sorted(k[0] for k in self.waiting.keys())
        out = []
        for ts in [t for t in steps if t <= reached]:
            active, hold = self.waiting.getValue((ts,))
            self.waiting.removeKey((ts,))
            if since is not None and ts - last > self.step:
                out.append((last + self.step, None, "inactive"))
                since = last = None
            if not active:
                since = last = None
                out.append((ts, None, "inactive"))
                continue
            since, last = ts if since is None else since, ts
            out.append((ts, since, "firing" if ts - since >= hold * MICROS else "pending"))
        left = [t for t in steps if t > reached]
        if since is not None and last + self.step < reached and not (left and left[0] - last <= self.step):
            out.append((last + self.step, None, "inactive"))
            since = last = None
        if left or since is not None:
            self._remind(since, last, None, min([*left[:1], *([last + self.step + 1000] if since is not None else [])]))
        else:
            self.run.clear()
        if out:
            at, begun, state = zip(*out)
            stamp = lambda x: pd.to_datetime(pd.Series(x, dtype="Int64"), unit="us")
            yield pd.DataFrame({"rule": key[0], "label_key": key[1], "ts": stamp(at), "since": stamp(begun), "state": state})

    def _held(self) -> tuple:
        return tuple(self.run.get()) if self.run.exists() else (None, None, None)

    def _remind(self, since: int | None, last: int | None, timer: int | None, micros: int) -> None:
        """One timer at a time: the earliest."""
        due = -(-micros // 1000)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.run.update((since, last, timer))

    def close(self) -> None:
        pass


def live_alerts(conditions: DataFrame, step_seconds: int = 15, delay: str = "1 minute") -> DataFrame:
    """Alert states of a stream of evaluated conditions: rule, label_key, ts, active, hold_seconds.

    Steps may arrive in any order within ``delay`` (the watermark); a state is told once the watermark has
    passed its step, so it never changes afterwards. Steps later than that are dropped."""
    return conditions.withWatermark("ts", delay).groupBy("rule", "label_key").transformWithStateInPandas(
        HoldProcessor(step_seconds), ALERT_OUTPUT, "Append", "EventTime")


def conditions_of(series: DataFrame, rule: str, hold_seconds: int, condition: Column,
                  label_key: Column) -> DataFrame:
    """A threshold rule evaluated on every sample of a stream."""
    return series.select(F.lit(rule).alias("rule"), label_key.alias("label_key"), "ts",
                         condition.alias("active"), F.lit(hold_seconds).alias("hold_seconds"))
