"""Pipeline metrics over batch rows, probes and benchmark runs.

A *batch frame* has one row per (batch_id, table_name) and possibly repeats of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelake.functions.scalars import millis_between, ratio
from changelake.functions.stats import CHUNK_SECONDS, combine_rows, medians, nearest_rank, order_statistics, running

# Write time counted as slow, window of the ingest rate, default probe timeout.
SLOW_MERGE_MS = 10_000
RATE_WINDOW_SECONDS = 300
PROBE_TIMEOUT_SECONDS = 120
NO_GAIN = 1.05
COUNTERS = ["kafka_records", "rows_merged", "inserts", "updates", "deletes", "merge_ms"]


def dedup_batches(df: DataFrame) -> DataFrame:
    """One row per batch and table; a replayed batch may have recorded its rows twice."""
    keep = [F.max(c).alias(c) for c in [*COUNTERS, "schema_changes"] if c in df.columns]
    return df.groupBy("batch_id", "table_name").agg(
        *keep, F.min("batch_started_at").alias("batch_started_at"),
        F.max("batch_finished_at").alias("batch_finished_at"))


def percentiles(df: DataFrame, keys: list[str], value: str, exact: bool) -> DataFrame:
    """p50, p95 and max of a value per group: nearest rank, or approximate."""
    if exact:
        stats = order_statistics(df, keys, value, {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)})
        return stats.select(*keys, "p50", "p95", "max")
    both = df.groupBy(*keys).agg(F.percentile_approx(value, [0.5, 0.95]).alias("_p"), F.max(value).alias("max"))
    return both.select(*keys, F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p95"), "max")


def ingest_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per table: batches, rows, records, merge time and its percentiles, rows per second."""
    once = dedup_batches(df)
    sums = once.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("rows_merged").alias("rows_merged"),
        F.sum("kafka_records").alias("kafka_records"), F.sum("merge_ms").alias("merge_ms_total"))
    spread = percentiles(once, ["table_name"], "merge_ms", exact)
    return (sums.join(spread, "table_name")
            .select("table_name", "batches", "rows_merged", "kafka_records", "merge_ms_total",
                    ratio(F.col("rows_merged") * 1000, F.col("merge_ms_total")).alias("merge_rows_per_sec"),
                    F.col("p50").alias("merge_ms_p50"), F.col("p95").alias("merge_ms_p95"),
                    F.col("max").alias("merge_ms_max"))
            .orderBy("table_name"))


def timeline(df: DataFrame) -> DataFrame:
    """Batches in order: end, records and duration."""
    return (dedup_batches(df).groupBy("batch_id")
            .agg(F.max("batch_finished_at").alias("finished_at"), F.sum("kafka_records").alias("records"),
                 F.min("batch_started_at").alias("_started"))
            .select("batch_id", "finished_at", "records",
                    millis_between("_started", "finished_at").alias("duration_ms"))
            .orderBy("batch_id"))


def throughput(df: DataFrame, exact: bool = False) -> DataFrame:
    """Over all batches: records, seconds, duration percentiles, overall and peak records/s."""
    batch = timeline(df)
    totals = batch.agg(
        F.count(F.lit(1)).alias("batches"), F.sum("records").alias("records"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max(ratio(F.col("records") * 1000, F.col("duration_ms"))).alias("peak_records_per_sec"))
    spread = percentiles(batch, [], "duration_ms", exact)
    return (combine_rows(totals, spread).select(
        "batches", "records", "duration_ms",
        ratio(F.col("records") * 1000, F.col("duration_ms")).alias("records_per_sec"),
        F.col("p50").alias("duration_ms_p50"), F.col("p95").alias("duration_ms_p95"),
        "peak_records_per_sec"))


def latest_merge(df: DataFrame, since: Column | None = None) -> DataFrame:
    """Merge time of the newest batch per table."""
    recent = df.where(F.col("batch_finished_at") > since) if since is not None else df
    return recent.groupBy("table_name").agg(F.max_by("merge_ms", F.struct("batch_id", "merge_ms")).alias("merge_ms"))


def op_totals(df: DataFrame, hidden: str = "shop.cdc_probe", last: int = 30) -> DataFrame:
    """Inserts, updates and deletes of the newest batches, without the heartbeat table."""
    return (dedup_batches(df).where(F.col("table_name") != hidden).groupBy("batch_id")
            .agg(*[F.sum(c).alias(c) for c in ("inserts", "updates", "deletes")])
            .orderBy(F.desc("batch_id")).limit(last))


def slow_batches(df: DataFrame, limit_ms: int = SLOW_MERGE_MS) -> DataFrame:
    return dedup_batches(df).withColumn("slow", F.col("merge_ms") >= limit_ms)


def schema_audit(df: DataFrame) -> DataFrame:
    """Batches that changed a schema."""
    return (df.where(F.col("schema_changes").isNotNull())
            .select("batch_id", "table_name", "schema_changes").distinct().orderBy("batch_id", "table_name"))


def ingest_rate(df: DataFrame, now: Column) -> DataFrame:
    """Records per second and batches of the last five minutes, age of the newest batch."""
    hour = dedup_batches(df.where(F.col("batch_finished_at") > now - F.expr("INTERVAL 1 HOUR")))
    fresh = F.col("batch_finished_at") > now - F.expr(f"INTERVAL {RATE_WINDOW_SECONDS} SECONDS")
    ever = df.agg(F.max("batch_finished_at")).scalar()
    return hour.agg(
        (F.coalesce(F.sum(F.when(fresh, F.col("kafka_records"))), F.lit(0))
         / float(RATE_WINDOW_SECONDS)).alias("records_per_sec"),
        F.countDistinct(F.when(fresh, F.col("batch_id"))).alias("batches_5m"),
        F.max("batch_finished_at").alias("_newest")).select(
        "records_per_sec", "batches_5m",
        (millis_between(F.coalesce("_newest", ever), now) / 1000.0).alias("last_batch_age_s"))


def freshness(probes: DataFrame, now: Column, heartbeat: int = 0) -> DataFrame:
    """Age of the newest heartbeat row that the lake shows."""
    return (probes.where(F.col("probe_id") == heartbeat).agg(F.max("created_at").alias("_newest"))
            .select((millis_between(F.col("_newest"), now) / 1000.0).alias("freshness_s")))


def latency_percentiles(df: DataFrame, value: str, keys: list[str] = (), exact: bool = True) -> DataFrame:
    """min, p50, p95, max and mean of samples; percentiles by nearest rank."""
    keys = list(keys)
    spread = percentiles(df, keys, value, exact)
    basics = df.groupBy(*keys).agg(F.count(value).alias("samples"), F.min(value).alias("min"),
                                   F.avg(value).alias("mean"))
    return combine_rows(basics, spread, keys).select(*keys, "samples", "min", "p50", "p95", "max", "mean")


def commit_to_merge(current: DataFrame, keys: list[str] = (), exact: bool = True) -> DataFrame:
    """Time from the source commit to the merge of each row, as percentiles."""
    lag = current.withColumn("lag_ms", millis_between("_cdc_source_ts", "_ingested_at"))
    return latency_percentiles(lag, "lag_ms", keys, exact)


def run_medians(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median time per query over its runs."""
    return medians(runs, keys, value, f"median_{value}").select(*keys, f"median_{value}")


def match_probes(sent: DataFrame, visible: DataFrame, timeout: float = PROBE_TIMEOUT_SECONDS) -> DataFrame:
    """Sent probes with the time until they were visible; later than the timeout is a miss."""
    both = sent.join(visible, "probe_id", "left")
    wait = millis_between("sent_at", "visible_at")
    return both.withColumn("latency_ms", F.when(wait <= timeout * 1000, wait)) \
               .withColumn("timed_out", F.col("latency_ms").isNull())


def nearest_batch(commits: DataFrame, batches: DataFrame, chunk_seconds: int | None = None) -> DataFrame:
    """For each source commit the first batch (lowest id) of its table that ended at or after
    one second before it.

    Commits and batch ends are merged on one time axis per table and the lowest batch is carried backwards
    with its figures, instead of pairing every commit with every later batch or joining back on the batch.
    """
    chunk_seconds = chunk_seconds or CHUNK_SECONDS
    figures = ["kafka_records", "rows_merged", "merge_ms", "batch_started_at", "batch_finished_at"]
    once = dedup_batches(batches).withColumn("_batch", F.struct("batch_id", *figures))
    earliest = F.col("committed_at") - F.expr("INTERVAL 1 SECOND")
    axis = commits.select(
        "table_name", F.unix_micros(earliest.cast("timestamp")).alias("_us"), F.lit(1).alias("_second"), "commit_id",
        "committed_at").unionByName(
        once.select("table_name", F.unix_micros(F.col("batch_finished_at").cast("timestamp")).alias("_us"),
                    F.lit(0).alias("_second"), "_batch"), allowMissingColumns=True)
    # backwards in time; at the same instant the batch counts for the commit
    axis = axis.withColumn("_back", -F.col("_us"))
    found = running(axis, ["table_name"], ["_back", "_second"],
                    F.floor(F.col("_back") / F.lit(chunk_seconds * 1_000_000)),
                    F.col("_batch"), "_found", "min").where("_second = 1")
    return found.select("table_name", "commit_id", "committed_at", "_found.*")


def trace(source: DataFrame, lake: DataFrame, batches: DataFrame, requests: DataFrame, pk: str,
          table_name: str, carried_at: Column | None = None) -> DataFrame:
    """State of many traced writes at once.

    ``requests``: key, txn_start, committed_at, gone (the write was a delete). A write has
    arrived when the lake row shows it, when it is gone as expected, or when the lake holds a
    later change of the same row; then the carrying batch is attached: the first one from ``carried_at`` on,
    a column over the requests and the lake row's metadata, by default (and where it is NULL) the write's own
    commit.
    """
    src = source.select(F.col(pk).alias("key"), F.lit(True).alias("_src"))
    dst = lake.select(F.col(pk).alias("key"), F.lit(True).alias("_dst"), "_cdc_op", "_cdc_source_ts",
                      "_cdc_lsn", "_ingested_at")
    seen = requests.join(src, "key", "left").join(dst, "key", "left")
    in_lake, in_source = F.col("_dst").isNotNull(), F.col("_src").isNotNull()
    later = in_lake & (F.col("_cdc_source_ts") >= F.col("txn_start"))
    status = (F.when(F.col("gone") & ~in_lake, "gone").when(later, "arrived")
              .when(~in_lake & ~in_source, "deleted by another session").otherwise("waiting"))
    told = seen.withColumn("status", status).withColumn(
        "latency_s", F.when(later, millis_between("committed_at", "_ingested_at") / 1000.0))
    own = F.col("committed_at")
    carriers = nearest_batch(
        told.where(F.col("status") != "waiting").select(
            F.lit(table_name).alias("table_name"), F.col("key").alias("commit_id"),
            (own if carried_at is None else F.coalesce(carried_at, own)).alias("committed_at")), batches)
    return told.drop("_src", "_dst").join(
        carriers.select(F.col("commit_id").alias("key"), "batch_id", "merge_ms", "batch_finished_at"),
        "key", "left")


def position_lag(landed: DataFrame, lake: DataFrame) -> DataFrame:
    """Log positions landed but not yet in the lake, per table."""
    have = lake.groupBy("table_name").agg(F.max("_cdc_lsn").alias("lake_lsn"))
    want = landed.groupBy("table_name").agg(F.max("lsn").alias("landed_lsn"))
    return (want.join(have, "table_name", "left")
            .select("table_name", "landed_lsn", "lake_lsn",
                    (F.col("landed_lsn") - F.coalesce("lake_lsn", F.lit(0))).alias("lag")))


def compare_runs(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Before and after side by side with speed-up and change in percent."""
    b = before.select(key, F.col(value).alias("before"))
    a = after.select(key, F.col(value).alias("after"))
    return b.join(a, key).select(
        key, "before", "after", ratio(F.col("before"), F.col("after")).alias("speedup"),
        ((ratio(F.col("after"), F.col("before")) - 1) * 100).alias("change_pct"))


def run_summary(compared: DataFrame, key: str) -> DataFrame:
    """Totals, overall speed-up, the best query and how many did not gain."""
    return compared.agg(
        F.sum("before").alias("before_total"), F.sum("after").alias("after_total"),
        ratio(F.sum("before"), F.sum("after")).alias("speedup"),
        F.max_by(key, F.struct("speedup", key)).alias("best"), F.max("speedup").alias("best_speedup"),
        F.count_if(F.col("speedup") < NO_GAIN).alias("slower"))
