import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from changelake.functions import scalars, stats
from changelake.operators import alerts, metrics, series

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(s):
    return T0 + timedelta(seconds=s)


def sec(ts):
    return (ts.replace(tzinfo=timezone.utc) - T0).total_seconds()


def frame(spark, rows, ddl="k string, ts timestamp, value double"):
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize("kind, inclusive", [("last", True), ("last", False), ("min", True), ("max", False), ("sum", True)])
def test_running_equals_a_plain_scan(spark, kind, inclusive):
    rnd, rows = random.Random(kind), []
    for i in range(400):
        key = "hot" if rnd.random() < 0.6 else rnd.choice("ab")
        rows.append((key, i, None if rnd.random() < 0.2 else rnd.randrange(100)))
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {r.i: r.out for r in stats.running(df, ["k"], ["i"], F.floor(F.col("i") / 7), F.col("v"), "out",
                                             kind, inclusive).collect()}
    acc = {}
    fold = {"last": lambda a, v: v, "min": lambda a, v: v if a is None else min(a, v),
            "max": lambda a, v: v if a is None else max(a, v), "sum": lambda a, v: v if a is None else a + v}[kind]
    assert len(got) == 400
    for k, i, v in rows:
        before = acc.get(k)
        if v is not None:
            acc[k] = fold(before, v)
        assert got[i] == (acc.get(k) if inclusive else before), (k, i)


def test_order_statistics(spark):
    rnd = random.Random(1)
    rows = [("hot", float(rnd.randrange(50))) for _ in range(301)] + [("b", 3.0), ("b", 1.0), ("one", 9.0)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r.k: r for r in stats.order_statistics(df, ["k"], "value", {
        "p50": stats.nearest_rank(0.5), "p95": stats.nearest_rank(0.95), "i9": stats.index_rank(0.9)}).collect()}
    for key in ("hot", "b", "one"):
        vals = sorted(v for k, v in rows if k == key)
        rank = lambda p: vals[max(0, math.ceil(round(p * len(vals), 6)) - 1)]
        r = got[key]
        assert (r.n, r.min, r.max) == (len(vals), vals[0], vals[-1])
        assert (r.p50, r.p95, r.i9) == (rank(0.5), rank(0.95), vals[min(len(vals) - 1, int(0.9 * len(vals)))])
    med = {r.k: r.median for r in stats.medians(df, ["k"], "value").collect()}
    assert med["b"] == 2.0 and med["one"] == 9.0
    assert stats.order_statistics(df, [], "value", {"m": stats.nearest_rank(0.5)}).first().n == 304


def test_selection_over_twelve_decades(spark, monkeypatch):
    """Continuous values of very different sizes, a value that a third of a group holds, small groups, NULL keys:
    in rounds of few splitters, with tasks of near equal size."""
    monkeypatch.setattr(stats, "RANGE_ROWS", 300)
    monkeypatch.setattr(stats, "SPLITTERS", 16)
    rnd = random.Random(9)
    rows = [("wide", rnd.choice([-1, 1]) * 10 ** rnd.uniform(-6, 6)) for _ in range(20000)]
    rows += [("heavy", 7.25 if rnd.random() < 0.4 else rnd.gauss(7, 1)) for _ in range(6000)]
    rows += [("same", 3.0)] * 2000 + [(None, float(i)) for i in range(900)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(8)
    shares = {f"p{round(1000 * p)}": p for p in (0.001, 0.25, 0.5, 0.95, 0.999)}
    got = {r.k: r for r in stats.order_statistics(df, ["k"], "value", {n: stats.nearest_rank(p) for n, p in shares.items()}).collect()}
    assert set(got) == {"wide", "heavy", "same", None, "one"}
    for key, r in got.items():
        vals = sorted(v for k, v in rows if k == key)
        assert (r.n, r.min, r.max) == (len(vals), vals[0], vals[-1])
        for name, p in shares.items():
            assert r[name] == vals[max(0, math.ceil(round(p * len(vals), 6)) - 1)], (key, name)
    whole = stats.order_statistics(df, [], "value", {"m": stats.nearest_rank(0.5)}).first()
    vals = sorted(v for _, v in rows if v is not None)
    assert whole.m == vals[math.ceil(len(vals) / 2) - 1]


def test_look_back_grows_with_the_rows(spark):
    """A series of many rows in one window: each row is met twice, windows are not read again."""
    df = spark.range(3000).select(F.lit("s").alias("k"), (F.lit(T0) + F.make_interval(secs=F.col("id") / 1000.0)).alias("ts"),
                                  F.col("id").alias("total"))
    out = stats.look_back(df, ["k"], "ts", 10, F.struct("ts", "total"), "first")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan
    assert out.count() == 3000 and out.agg(F.max("first.total")).first()[0] == 0


def test_delta_reads_one_chunk(spark):
    rows = [("a", at(i * 7), float(i)) for i in range(2000)] + [(None, at(i), float(-i)) for i in range(900)] + [("short", at(0), 1.0)]
    for window in (30, 300, 7000, 10**6):
        got = {r.k: (r.now, r.before) for r in series.delta(frame(spark, rows), ["k"], window).collect()}
        for key in ("a", None, "short"):
            mine = sorted((ts, v) for k, ts, v in rows if k == key)
            last = mine[-1]
            old = [x for x in mine if x[0] <= last[0] - timedelta(seconds=window)]
            ref = old[-1] if old else mine[0]
            far = (last[0] - ref[0]).total_seconds() >= window / 2
            assert got[key] == (last[1], ref[1] if far else None), (key, window)


def test_resample_lookback_and_carry(spark):
    df = frame(spark, [("a", at(1), 1.0), ("a", at(14), 2.0), ("a", at(44), 3.0), ("a", at(1000), 4.0), ("b", at(30), 5.0)])
    got = {(r.k, sec(r.ts)): r.value for r in series.resample(df, ["k"], 15, 60).collect()}
    want = {("a", 15): 2.0, ("a", 30): 2.0, ("a", 45): 3.0, ("a", 60): 3.0, ("a", 75): 3.0, ("a", 90): 3.0,
            ("a", 1005): 4.0, ("a", 1020): 4.0, ("a", 1035): 4.0, ("a", 1050): 4.0,
            ("b", 30): 5.0, ("b", 45): 5.0, ("b", 60): 5.0, ("b", 75): 5.0, ("b", 90): 5.0}
    assert got == want


def test_chunks_do_not_change_results(spark):
    df = frame(spark, [("hot", at(i / 10), float(i)) for i in range(2000)] + [("b", at(5000), 1.0)])
    short, long = (sorted(map(tuple, series.counter_rate(df, ["k"], ["ts"], 120, chunk).collect())) for chunk in (7, 86_400))
    assert short == long and len(short) == 3


def test_counter_rate_with_restart(spark):
    df = frame(spark, [("c", at(0), 10.0), ("c", at(60), 40.0), ("c", at(119), 5.0), ("c", at(130), 7.0)])
    got = {sec(r.window_start): (r.increase, r.rate) for r in series.counter_rate(df, ["k"], ["ts"], 120).collect()}
    assert got == {0: (35.0, 35 / 120), 120: (2.0, 2 / 120)}


def test_delta_rules(spark):
    rows = [("far", at(0), 1.0), ("far", at(250), 2.0), ("far", at(600), 9.0),   # newest sample 300 s or more older
            ("short", at(0), 4.0), ("short", at(200), 6.0),                       # falls back to the first sample
            ("tiny", at(0), 4.0), ("tiny", at(100), 6.0), ("one", at(0), 1.0)]    # too close: NULL
    got = {r.k: (r.now, r.before, r.abs) for r in series.delta(frame(spark, rows), ["k"]).collect()}
    assert got == {"far": (9.0, 2.0, 7.0), "short": (6.0, 4.0, 2.0), "tiny": (6.0, None, None), "one": (1.0, None, None)}


def test_trailing_rate_against_brute_force(spark):
    rnd, t, total, rows = random.Random(2), 0.0, 0, []
    for _ in range(300):
        t += rnd.choice([0.25, 0.5, 3, 11])
        total += rnd.randrange(5)
        rows.append(("hot", at(t), total))
    df = spark.createDataFrame(rows, "k string, ts timestamp, total long")
    out = series.trailing_rate(df, ["k"], "total", 10)
    got = {sec(r.ts): r.rate for r in out.collect()}
    assert len(got) == 300
    for _, ts, total in rows:
        first = min((r for r in rows if 0 <= (ts - r[1]).total_seconds() <= 10), key=lambda r: r[1])
        span = (ts - first[1]).total_seconds()
        want = (total - first[2]) / span if span >= 1 else 0.0
        assert got[(ts - T0).total_seconds()] == pytest.approx(want)


def test_summary_clips_outliers(spark):
    rows = [("spiky", at(i), 1.0) for i in range(99)] + [("spiky", at(99), 100.0)]
    rows += [("calm", at(i), float(i)) for i in range(10)]
    got = {r.k: (r.median, r.p90, r.clipped, r.shown_max) for r in series.series_summary(frame(spark, rows), ["k"]).collect()}
    assert got == {"spiky": (1.0, 1.0, True, 2.0), "calm": (5.0, 9.0, False, 9.0)}


def test_change_points_treat_null_as_a_value(spark):
    rows = [("a", 0, 1), ("a", 1, 1), ("a", 2, None), ("a", 3, None), ("a", 4, 1), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    got = series.change_points(df, ["k"], ["i"], "v", F.floor(F.col("i") / 2)).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 0), ("a", 2), ("a", 4), ("b", 0)]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")


def test_standard_alert_rules(spark):
    steps = range(0, 1200, 15)
    rows = [("lakehouse_cdc_freshness_seconds", {}, at(s), 500.0 if 300 <= s < 600 else 1.0) for s in steps]
    # the connector metric disappears after 900 s (samples stay valid for 300 s) and is 0 around 450 s
    rows += [("lakehouse_connector_running", {"connector": "pg"}, at(s), 0.0 if 450 <= s < 480 else 1.0)
             for s in steps if s < 600]
    rows += [("lakehouse_iceberg_files", {"table": t, "content": c}, at(s), 900.0)
             for s in steps for t in ("orders", "customer") for c in ("data", "deletes")]
    rows += [("lakehouse_iceberg_avg_data_file_bytes", {"table": t}, at(s), 1000.0 if t == "orders" else 1e9)
             for s in steps for t in ("orders", "customer")]
    rows += [("lakehouse_ingest_last_batch_age_seconds", {}, at(s), 700.0) for s in steps]
    rows += [("lakehouse_replication_slot_lag_bytes", {"slot": "x"}, at(s), 600 * 1024 * 1024.0 if s < 90 else 20 * 1024 * 1024.0)
             for s in steps]
    hist = alerts.alert_history(labelled(spark, rows)).cache()
    seen = {}
    for r in hist.collect():
        seen.setdefault((r.rule, r.label_key), {})[sec(r.ts)] = (r.state, sec(r.since))
    fresh = seen[("CdcFreshnessHigh", "")]
    assert min(fresh) == 300 and max(fresh) == 585
    assert fresh[405] == ("pending", 300) and fresh[420] == ("firing", 300)
    down = seen[("DebeziumConnectorDown", "connector=pg")]
    assert set(down) == {450, 465} and {s for s, _ in down.values()} == {"pending"}
    gone = seen[("DebeziumConnectorDown", "")]
    assert min(gone) == 900 and gone[960] == ("firing", 900)  # last sample 585 s, valid for 300 s
    assert {k[1] for k in seen if k[0] == "SmallFilesAccumulating"} == {"content=data,table=orders"}
    assert seen[("SmallFilesAccumulating", "content=data,table=orders")][600][0] == "firing"
    assert max(seen[("ReplicationSlotLagHigh", "slot=x")]) == 75
    assert seen[("StreamingStalled", "")][120] == ("firing", 0)
    now = alerts.rule_states(hist, alerts.RULES, F.lit(at(1170))).collect()
    assert [(r.rule, r.state) for r in now] == [
        ("DebeziumConnectorDown", "firing"), ("SmallFilesAccumulating", "firing"), ("StreamingStalled", "firing"),
        ("CdcFreshnessHigh", "inactive"), ("ReplicationSlotLagHigh", "inactive")]


def test_nearest_batch_takes_the_lowest_id(spark):
    batches = spark.createDataFrame(
        [(n, "t", 1, 1, 0, 0, 0, 5, at(e - 1), at(e)) for n, e in [(1, 10), (2, 30), (3, 25), (4, 50)]],
        "batch_id long, table_name string, kafka_records long, rows_merged long, inserts long, updates long, "
        "deletes long, merge_ms long, batch_started_at timestamp, batch_finished_at timestamp")
    commits = spark.createDataFrame([(i, "t", at(s)) for i, s in enumerate([0, 11, 12, 26, 27, 99])] + [(9, "u", at(0))],
                                    "commit_id long, table_name string, committed_at timestamp")
    got = {r.commit_id: (r.batch_id, r.merge_ms) for r in metrics.nearest_batch(commits, batches, 20).collect()}
    assert got == {0: (1, 5), 1: (1, 5), 2: (2, 5), 3: (2, 5), 4: (2, 5), 5: (None, None), 9: (None, None)}


def test_ingest_rate_falls_back_to_the_newest_batch_ever(spark):
    cols = ("batch_id long, table_name string, kafka_records long, merge_ms long, batch_started_at timestamp, "
            "batch_finished_at timestamp")
    df = spark.createDataFrame([(1, "t", 600, 5, at(-5), at(0)), (1, "t", 600, 5, at(-5), at(0)), (2, "t", 300, 5, at(50), at(60))], cols)
    r = metrics.ingest_rate(df, F.lit(at(100))).first()
    assert (r.records_per_sec, r.batches_5m, r.last_batch_age_s) == (3.0, 2, 40.0)
    r = metrics.ingest_rate(df, F.lit(at(90_000))).first()
    assert (r.records_per_sec, r.batches_5m, r.last_batch_age_s) == (0.0, 0, 89_940.0)


def test_run_comparison(spark):
    b = spark.createDataFrame([("q1", 100.0), ("q2", 50.0)], "q string, ms double")
    a = spark.createDataFrame([("q1", 10.0), ("q2", 49.0)], "q string, ms double")
    s = metrics.run_summary(metrics.compare_runs(b, a, "q", "ms"), "q").first()
    assert (s.best, s.best_speedup, s.slower) == ("q1", 10.0, 1) and s.speedup == pytest.approx(150 / 59)


def test_scalars(spark):
    df = spark.createDataFrame([(89.0,), (150.0,), (7200.0,), (200000.0,)], "s double")
    assert [r.a for r in df.select(scalars.human_age(F.col("s")).alias("a")).collect()] == ["89s", "2 min", "2 h", "2 days"]
    df = spark.createDataFrame([(5,), (1536,), (3 * 1024**2,), (5 * 1024**4,)], "n long")
    assert [r.a for r in df.select(scalars.human_bytes(F.col("n")).alias("a")).collect()] == [
        "5.0 B", "1.5 KB", "3.0 MB", "5.0 TB"]
    safe = scalars.json_safe(spark.sql(
        "SELECT double('NaN') AS n, double('Infinity') AS i, 1.5D AS f, 9007199254740993L AS l, "
        "cast(1.50 as decimal(5,2)) AS d, cast('hi' as binary) AS b, date'2024-01-02' AS day")).first()
    assert (safe.n, safe.i, safe.f, safe.l, safe.d, safe.b, safe.day) == (
        None, None, 1.5, "9007199254740993", "1.50", "6869", "2024-01-02")


def test_a_null_series_is_a_series(spark):
    rows = [(None if i % 2 else "a", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {r.k: r.median for r in stats.medians(df, ["k"], "value").collect()} == {"a": 749.0, None: 750.0}
    grown = series.counter_rate(df, ["k"], ["ts"], 3600).groupBy("k").agg(F.sum("increase").alias("s")).collect()
    assert {r.k: r.s for r in grown} == {"a": 1498.0, None: 1498.0}
    assert {r.k: r.now for r in series.delta(df, ["k"], 60).collect()} == {"a": 1498.0, None: 1499.0}


def test_resample_takes_the_first_of_one_instant(spark):
    df = frame(spark, [("a", at(1), 2.0), ("a", at(1), 9.0)]).withColumn("n", F.col("value"))
    got = {r.value for r in series.resample(df, ["k"], 15, 30, recorded="n").collect()}
    assert got == {2.0} and {r.value for r in series.resample(df, ["k"], 15, 30).collect()} == {9.0}
