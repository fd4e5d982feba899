"""Headline timings: the query suite before and after layout, ingestion, folding, maintenance.

Prints one JSON line. Each query is timed like a client would see it: one warm-up, then the
median of three runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from changelake import Lake
from changelake.operators import quality
from changelake.operators.changes import fold
from changelake.plans import layout, registry, suite
from changelake.session import build_session, shared_dir
from changelake.sources import envelope, raw, tables
from changelake.streaming.ingest import run

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def median_time(job) -> float:
    job()
    samples = []
    for _ in range(RUNS):
        begun = time.perf_counter()
        job()
        samples.append(time.perf_counter() - begun)
    return round(statistics.median(samples), 4)


def once(job):
    begun = time.perf_counter()
    result = job()
    return round(time.perf_counter() - begun, 4), result


def suite_jobs(src) -> dict:
    return {
        "q01": lambda: suite.q01(src, 480).collect(),
        "q02": lambda: suite.q02(src, "1995-03-01", "1995-03-31").collect(),
        "q03": lambda: suite.q03(src, "1994-01-01", "1997-01-01").collect(),
        "q04": lambda: suite.q04(src, "1996-01-01", "1997-01-01").collect(),
        "q05": lambda: suite.q05(src).collect(),
        "q06": lambda: suite.q06(src).collect(),
        "q07": lambda: suite.q07(src, "1995-01-01", "1995-03-31").collect(),
        "q08": lambda: suite.q08(src, 144).collect(),
    }


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "bench", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = shared_dir(spark, "bench")
    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    # queries on the plain tables
    for name, job in suite_jobs(suite.ParquetSource(spark, SF_DIR)).items():
        times[f"{name}_parquet"] = median_time(job)

    # ingestion of all four source tables and a change log of orders through the stream
    src = tables.parquet_tables(spark, SF_DIR)
    for name in ("region", "nation", "customer"):
        key = tables.PRIMARY_KEYS[name]
        envelope.encode(src(name), key, f"pg.shop.{name}", F.lit("r"), F.col(key[0]), F.lit(1), F.lit(0)) \
            .write.parquet(f"{folder}/raw/0-{name}")
    log = registry.changes(spark, SF_DIR)
    envelope.encode(log, registry.PK, "pg.shop.orders", F.col("_cdc_op"), F.col("_offset"), F.col("_cdc_lsn"),
                    F.lit(0)).repartitionByRange(8, "offset").write.parquet(f"{folder}/raw/1-orders")
    records = spark.read.parquet(f"{folder}/raw/0-region", f"{folder}/raw/0-nation", f"{folder}/raw/0-customer",
                                 f"{folder}/raw/1-orders").count()
    stream = raw.raw_source(spark, "parquet", f"{folder}/raw", cap=4)
    times["stream_ingest"], _ = once(lambda: run(
        stream, f"{folder}/lake", f"{folder}/checkpoint", {"availableNow": True}).awaitTermination())
    extra["ingest_records"] = records
    extra["ingest_records_per_sec"] = round(records / times["stream_ingest"], 1)

    lake = Lake(spark, f"{folder}/lake")
    lake_src = suite.LakeSource(lake)
    want = {"orders": fold([log], registry.PK).select(*registry.ORDER_COLUMNS),
            **{n: src(n) for n in ("region", "nation", "customer")}}
    have = lambda: {n: lake_src(n) for n in want}
    times["reconcile"], before = once(lambda: quality.compare(want, have()).collect())

    # the suite on the streaming layout, then on the optimised one
    for name, job in suite_jobs(lake_src).items():
        times[f"{name}_before"] = median_time(job)
    names = [f"shop.{n}" for n in want]
    times["maintenance"], _ = once(lambda: layout.maintain(
        spark, f"{folder}/lake", names, layout=True, compaction=True, expiry=True, expire_minutes=0, retain_last=1))
    for name, job in suite_jobs(lake_src).items():
        times[f"{name}_after"] = median_time(job)
    after = quality.compare(want, have()).collect()
    if not all(r.ok for r in [*before, *after]):
        raise SystemExit(f"source and lake differ: {before} {after}")
    for phase in ("parquet", "before", "after"):
        extra[f"suite_{phase}"] = round(sum(v for k, v in times.items() if k.endswith(f"_{phase}")), 4)

    # operators
    for name in ("current_state", "row_history", "version_diff", "typed_decode", "batch_throughput",
                 "nearest_following_batch", "alert_states", "latency_percentiles"):
        times[name] = median_time(lambda: registry.QUERIES[name](spark, SF_DIR).write.format("noop")
                                  .mode("overwrite").save())
    print(json.dumps({"metric": "suite_after_layout", "value": extra["suite_after"], "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
