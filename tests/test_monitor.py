from pyspark.sql import functions as F

from changelake.operators import alerts
from changelake.streaming import monitor
from tests.conftest import SF

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def feed(spark, folder):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{folder}/in")
    return e, spark.readStream.schema(e.schema).parquet(f"{folder}/in")


def collect(spark, df, name, folder):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", f"{folder}/ck-{name}").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def hourly_conditions(spark):
    """The highest value of each event type and hour, with gaps; alert when it is above 5."""
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = e.groupBy("event_type", F.window("ts", "1 hour")).agg(F.max("value").alias("value")).select(
        "event_type", F.col("window.start").alias("ts"), "value")
    return hourly.where(F.pmod(F.xxhash64("event_type", "ts"), F.lit(9)) > 0)


def arrive(spark, rows, folder, files, slack_hours):
    """The rows as a stream of several files, each up to ``slack_hours`` late and some sent twice, closed by a row
    of another label far ahead."""
    late = rows.withColumn("_at", F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_type", "ts", F.lit(1)), F.lit(slack_hours * 3600)))
    bounds = late.select(F.percentile_approx("_at", [i / files for i in range(1, files)])).first()[0]
    part = sum((F.col("_at") > b).cast("int") for b in bounds)
    late = late.withColumn("_part", part)
    end = rows.agg(F.max("ts")).first()[0]
    for n in range(files):
        mine = late.where(F.col("_part") == n).select(*rows.columns)
        again = mine.where(F.pmod(F.xxhash64("ts"), F.lit(5)) == 0)
        mine.unionByName(again).orderBy(F.rand(n)).coalesce(1).write.mode("append").parquet(f"{folder}/late")
    closing = spark.createDataFrame([("closing", end, 0.0)], "event_type string, ts timestamp, value double").withColumn(
        "ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    closing.coalesce(1).write.mode("append").parquet(f"{folder}/late")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/late")


def test_live_alerts_equal_the_batch_operator(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    hourly = hourly_conditions(spark).cache()
    src = arrive(spark, hourly, folder, 5, 6)
    conditions = monitor.conditions_of(src, "High", 7200, F.col("value") > 5, F.col("event_type"))
    got = collect(spark, monitor.live_alerts(conditions, 3600, "7 hours"), "alerts_live", folder)
    active = hourly.where("value > 5").select(F.lit("High").alias("rule"), F.col("event_type").alias("label_key"), "ts")
    want = alerts.hold(active, ["rule", "label_key"], 3600, F.lit(7200))
    key = lambda d: sorted(tuple(r) for r in d.select("label_key", "ts", "since", "state").collect())
    assert key(got.where("state <> 'inactive'")) == key(want)
    assert got.where("state = 'firing'").count() > 0 and got.where("state = 'pending'").count() > 0
    # every run ends in an inactive state, and no state is left but that of the closing label
    ends = want.groupBy("label_key", "since").agg(F.max("ts").alias("last"))
    told = got.where("state = 'inactive'").select("label_key", "ts")
    resolved = ends.join(told, (ends.label_key == told.label_key) & (told.ts == F.col("last") + F.expr("INTERVAL 1 HOUR")))
    assert resolved.count() == ends.count()
    state = lambda name: spark.read.format("statestore").option("path", f"{folder}/ck-alerts_live").option(
        "stateVarName", name).load().select("key.label_key").distinct().collect()
    assert {r.label_key for name in ("waiting", "run") for r in state(name)} <= {"closing"}
    hourly.unpersist()


def test_live_rates_and_freshness(spark, folder):
    e, stream = feed(spark, folder)
    last = e.agg(F.max("ts")).first()[0]
    rate = collect(spark, monitor.live_trailing_rate(stream), "rate_live", folder)
    assert abs(rate.agg(F.sum("rate")).first()[0] - 1000) < 2  # each event counts in ten windows of a tenth
    batches = stream.select(F.floor(F.col("event_id") / 50).alias("batch_id"), F.col("event_type").alias("table_name"),
                            F.lit(10).alias("kafka_records"), F.col("ts").alias("batch_finished_at"))
    sliding = collect(spark, monitor.live_ingest_rate(batches), "ingest_live", folder)
    assert sliding.count() > 0 and sliding.where("records % 10 <> 0").count() == 0
    beats = stream.select(F.col("ts").alias("seen_at"), (F.col("ts") - F.expr("INTERVAL 7 SECONDS")).alias("created_at"))
    fresh = collect(spark, monitor.live_freshness(beats), "fresh_live", folder)
    assert fresh.where("freshness_s <> 7.0").count() == 0 and fresh.where(F.col("window_end") > last).count() == 0


def test_live_probe_match(spark, folder):
    _, stream = feed(spark, folder)
    sent = stream.select(F.col("event_id").alias("probe_id"), F.col("ts").alias("sent_at"))
    seen = stream.where("event_id % 11 <> 0").select(
        F.col("event_id").alias("probe_id"), (F.col("ts") + F.expr("INTERVAL 3 SECONDS")).alias("visible_at"))
    got = collect(spark, monitor.live_probe_match(sent, seen), "probes_live", folder)
    assert got.where("latency_ms = 3000").count() == 909
    assert got.where("latency_ms IS NULL AND probe_id % 11 <> 0").count() == 0
    assert got.where("latency_ms IS NULL").count() >= 88
