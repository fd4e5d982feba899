import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake import Lake
from changelake.operators import metrics, quality
from changelake.operators.changes import fold
from changelake.plans import layout
from changelake.sources import envelope, generate, raw, tables
from changelake.streaming.ingest import Ingest, batch_ranges, run
from tests.conftest import SF
from tests.test_envelope import K, change, record


def typed_log(spark):
    return generate.derived_changes(tables.parquet_tables(spark, SF)("orders"))


def write_raw(spark, folder, log, slices):
    """The raw records of a log in ``slices`` files, one per batch, cut by offset order."""
    rec = envelope.encode(log, ["o_orderkey"], "pg.shop.orders", F.col("_cdc_op"), F.col("_offset"),
                          F.col("_cdc_lsn"), F.lit(1700000000000))
    ranked = rec.repartitionByRange(slices, "offset").sortWithinPartitions("offset")
    ranked.write.parquet(f"{folder}/raw")


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_any_cut_gives_the_same_state(spark, folder, slices):
    log = typed_log(spark)
    write_raw(spark, folder, log, slices)
    stream = raw.raw_source(spark, "parquet", f"{folder}/raw", cap=1)
    run(stream, f"{folder}/lake", f"{folder}/ck", {"availableNow": True}).awaitTermination()
    lake = Lake(spark, f"{folder}/lake")
    table = lake.table("shop.orders")
    want = fold([log], ["o_orderkey"])
    cols = [c for c in want.columns if not c.startswith("_")]
    assert quality.checksum(table.current().select(*cols)).first() == quality.checksum(want.select(*cols)).first()
    m = lake.table("ops.ingest_batches").current()
    assert m.agg(F.sum("kafka_records")).first()[0] == log.count()
    assert m.where("schema_changes IS NOT NULL").count() == 1
    assert metrics.throughput(m).first().batches == m.count()


def test_replay_restart_and_floor(spark, folder):
    log = typed_log(spark)
    write_raw(spark, folder, log, 3)
    go = lambda: run(raw.raw_source(spark, "parquet", f"{folder}/raw", cap=1), f"{folder}/lake",
                     f"{folder}/ck", {"availableNow": True}).awaitTermination()
    go()
    lake = Lake(spark, f"{folder}/lake")
    table = lake.table("shop.orders")
    before, head = quality.checksum(table.current()).first(), table.head()
    stream_id = next(iter(head.streams))
    # the newest batch again, as after a crash between its commit and the checkpoint
    ingest = Ingest(spark, f"{folder}/lake", stream_id=stream_id)
    ingest(spark.read.parquet(f"{folder}/raw"), head.streams[stream_id])
    assert table.head().version == head.version and quality.checksum(table.current()).first() == before
    go()  # a restart without new input changes nothing
    assert table.head().version == head.version
    floor = raw.retention_floor(batch_ranges(lake.table("ops.ingest_batches").current()))
    assert floor.count() == 1
    files = spark.read.parquet(f"{folder}/raw").select("_metadata.file_path").distinct().count()
    removed = raw.trim_landed(spark, f"{folder}/raw", "parquet", floor)
    assert removed == files - 1  # everything but the input of the newest batch
    assert spark.read.parquet(f"{folder}/raw").agg(F.min("offset")).first()[0] >= floor.first().floor


def test_topics_evolution_and_hot_key(spark, folder):
    narrow = [K, {"field": "a", "type": "int32"}]
    wide = [K, {"field": "a", "type": "int64"}, {"field": "note", "type": "string"}]
    batches = [
        [record("pg.shop.x", i, narrow, change("c", i, {"k": i, "a": i}), {"k": i}) for i in range(5)]
        + [record("pg.shop.cdc_probe", 0, [K], change("c", 1, {"k": 0}), {"k": 0})],
        # one batch with two schemas and many changes of one key
        [record("pg.shop.x", 10 + i, narrow, change("u", 10 + i, {"k": 1, "a": i}), {"k": 1}) for i in range(200)]
        + [record("pg.shop.x", 300, wide, change("u", 300, {"k": 2, "a": 2**33, "note": "n"}), {"k": 2})],
        [record("pg.shop.x", 400, wide, change("d", 400), {"k": 3}), ("pg.shop.x", 0, 401, "{}", None)],
        # nothing but an ignored message, with a new column: the schema still evolves
        [record("pg.shop.x", 500, [*wide, {"field": "z", "type": "boolean"}], change("t", 500), {"k": 9})],
    ]
    ingest = Ingest(spark, f"{folder}/lake", stream_id="s")
    for n, rows in enumerate(batches):
        ingest(spark.createDataFrame(rows, envelope.RAW_SCHEMA), n)
    lake = Lake(spark, f"{folder}/lake")
    assert lake.names("shop") == ["shop.cdc_probe", "shop.x"]
    got = {r.k: (r.a, r.note) for r in lake.table("shop.x").current().collect()}
    assert got == {0: (0, None), 1: (199, None), 2: (2**33, "n"), 4: (4, None)}
    assert lake.table("shop.x").current().columns[:4] == ["k", "a", "note", "z"]
    audit = {r.batch_id: r.schema_changes for r in metrics.schema_audit(
        lake.table("ops.ingest_batches").current()).where("table_name = 'shop.x'").collect()}
    assert audit == {0: "new table: 2 columns, key k",
                     1: "wider column a int -> bigint; new column note string", 3: "new column z boolean"}
    m = {r.batch_id: r for r in lake.table("ops.ingest_batches").current().where("table_name = 'shop.x'").collect()}
    assert (m[1].kafka_records, m[1].rows_merged, m[1].updates) == (201, 2, 2)  # counted after the reduction
    assert m[2].deletes == 1


def test_refused_change_keeps_the_type(spark, folder):
    ingest = Ingest(spark, f"{folder}/lake", stream_id="s")
    text, number = [K, {"field": "a", "type": "int32"}], [K, {"field": "a", "type": "string"}]
    ingest(spark.createDataFrame([record("pg.shop.x", 0, text, change("c", 1, {"k": 1, "a": 5}), {"k": 1})],
                                 envelope.RAW_SCHEMA), 0)
    ingest(spark.createDataFrame([
        record("pg.shop.x", 1, number, change("c", 2, {"k": 2, "a": "17"}), {"k": 2}),
        record("pg.shop.x", 2, number, change("c", 3, {"k": 3, "a": "no number"}), {"k": 3})], envelope.RAW_SCHEMA), 1)
    lake = Lake(spark, f"{folder}/lake")
    assert {r.k: r.a for r in lake.table("shop.x").current().collect()} == {1: 5, 2: 17, 3: None}
    assert lake.table("ops.ingest_batches").current().agg(F.sum("cast_rejects")).first()[0] == 1


def test_two_topics_equal_their_fold(spark, folder):
    """Changes of two tables in batches that overlap in time equal one fold of each (count and checksum)."""
    src = tables.parquet_tables(spark, SF)
    orders = generate.derived_changes(src("orders")).drop("_version")
    customers = src("customer").withColumns({
        "_cdc_op": F.when(F.col("c_custkey") % 3 == 0, "u").otherwise("c"), "_cdc_lsn": F.col("c_custkey"), "_offset": F.col("c_custkey")})
    logs, keys = {"orders": orders, "customer": customers}, {"orders": ["o_orderkey"], "customer": ["c_custkey"]}
    both = reduce(DataFrame.unionByName, [envelope.encode(
        logs[t], keys[t], f"pg.shop.{t}", F.col("_cdc_op"), F.col("_offset"), F.col("_cdc_lsn"), F.lit(0)) for t in logs])
    ingest = Ingest(spark, f"{folder}/lake", stream_id="s")
    for n in range(3):
        ingest(both.where(F.col("offset") % 3 == n), n)
    lake = Lake(spark, f"{folder}/lake")
    want = {t: fold([logs[t]], keys[t]).drop("_cdc_op", "_cdc_lsn", "_offset") for t in logs}
    have = {t: lake.table(f"shop.{t}").current() for t in logs}
    assert all(r.ok for r in quality.compare(want, have).collect())
    ok, _, result = quality.wait_consistent(lambda: want, lambda: have, timeout=5)
    assert ok and len(result) == 2


def test_kafka_options():
    opts = raw.kafka_options("broker:9092", tasks=64)
    assert opts["subscribePattern"] == r"pg\.shop\..*" and opts["maxOffsetsPerTrigger"] == "100000"
    assert opts["startingOffsets"] == "earliest" and opts["minPartitions"] == "64"
    assert json.dumps(opts)


def test_sampling(spark):
    src = tables.parquet_tables(spark, SF)
    keys = generate.sample_keys(src("orders"), "o_orderkey", seed=1)
    assert 0 < keys.count() <= 200
    assert generate.sample_keys(src("region"), "r_regionkey", seed=5).count() == 1
    found = generate.erasure_candidates(src("customer"), src("orders"), seed=1)
    assert 0 < found.count() <= 50
    assert found.join(src("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").count() == 0


def test_odd_names(spark, folder):
    """Columns, keys and tables may carry dots, blanks, quotes and reserved words."""
    df = spark.range(6).select(F.col("id").alias("the.key"), F.lit("x").alias("a b.c"), F.lit(1).alias("order"),
                               F.lit("y").alias("tick`s"))
    rec = lambda d, op, at: envelope.encode(d, ["the.key"], "pg.shop.odd.name", F.lit(op), F.lit(at), F.lit(at), F.lit(0))
    ingest = Ingest(spark, f"{folder}/lake", stream_id="s")
    ingest(rec(df, "c", 1), 0)
    ingest(rec(df.where("`the.key` < 2").withColumn("a b.c", F.lit("z")), "u", 2)
           .unionByName(rec(df.where("`the.key` = 5"), "d", 3)), 1)
    table = Lake(spark, f"{folder}/lake").table("shop.odd.name")
    rows = {r["the.key"]: r["a b.c"] for r in table.current().collect()}
    assert rows == {0: "z", 1: "z", 2: "x", 3: "x", 4: "x"}
    assert {(r["the.key"], r.change) for r in table.diff(0, 1).collect()} == {(0, "updated"), (1, "updated"), (5, "deleted")}
    layout.compact(table, rewrite_all=True)
    table.erase(F.col("`the.key`") == 0)
    assert table.current().count() == 4 and table.row_history([0]).count() == 4
    assert Lake(spark, f"{folder}/lake").names("shop") == ["shop.odd.name"]


def test_empty_inputs(spark, folder):
    lake = Lake(spark, f"{folder}/lake")
    table = lake.table("shop.none")
    table.bootstrap(spark.createDataFrame([], "k long, a string"), ["k"])
    assert table.current().count() == 0 and table.head().version == 0
    table.erase(F.col("k") == 1)
    assert table.head().version == 0
    layout.compact(table, rewrite_all=True)
    assert table.current().count() == 0
    Ingest(spark, f"{folder}/lake", stream_id="s")(spark.createDataFrame([], envelope.RAW_SCHEMA), 0)
    assert lake.names() == ["shop.none"]


def test_records_of_another_layout_and_undecodable_ones(spark, folder):
    fields = [K, {"field": "a", "type": "int32"}]
    made = [record("pg.shop.x", i, fields, change("c", i, {"k": i, "a": i}), {"k": i}) for i in range(4)]
    spaced = [(t, p, o, json.dumps(json.loads(k), indent=1), json.dumps(json.loads(v), sort_keys=True, indent=2))
              if o >= 2 else (t, p, o, k, v) for t, p, o, k, v in made]
    frame = spark.createDataFrame(spaced, envelope.RAW_SCHEMA)
    Ingest(spark, f"{folder}/lake", stream_id="s")(frame, 0)
    lake = Lake(spark, f"{folder}/lake")
    assert {r.k: r.a for r in lake.table("shop.x").current().collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    bad = spark.createDataFrame([("pg.shop.x", 0, 9, None, "no json"), record("pg.shop.x", 10, fields, change(
        "c", 10, {"k": 10, "a": 1}), {"k": 10})], envelope.RAW_SCHEMA)
    with pytest.raises(ValueError, match="pg.shop.x/0/9"):
        Ingest(spark, f"{folder}/lake", stream_id="s")(bad, 1)
    Ingest(spark, f"{folder}/lake", stream_id="s", set_aside=f"{folder}/odd")(bad, 1)
    assert [(r.offset, r.value, r.fault) for r in spark.read.parquet(f"{folder}/odd").collect()] == [
        (9, "no json", "not an envelope")]
    assert Lake(spark, f"{folder}/lake").table("shop.x").current().count() == 5


def test_records_that_cannot_be_applied(spark, folder):
    """A cut payload, a missing op and a missing key stop the stream before their table's commit, or are set aside
    once, whatever is repeated."""
    fields = [K, {"field": "a", "type": "int32"}]
    good = [record("pg.shop.x", i, fields, change("c", i, {"k": i, "a": i}), {"k": i}) for i in range(3)]
    other = record("pg.shop.y", 0, fields, change("c", 1, {"k": 1, "a": 1}), {"k": 1})
    cut = (*good[0][:2], 10, good[0][3], good[0][4][:-20])
    no_op = record("pg.shop.x", 11, fields, {"source": {"lsn": 11}, "after": {"k": 11, "a": 1}}, {"k": 11})
    no_key = record("pg.shop.x", 12, fields, change("u", 12, {"k": 12, "a": 1}))
    frame = spark.createDataFrame([*good, other, cut, no_op, no_key], envelope.RAW_SCHEMA)
    strict = Ingest(spark, f"{folder}/lake", stream_id="s")
    for _ in range(2):
        with pytest.raises(ValueError, match="3 records cannot be applied, the first at pg.shop.x/0/10"):
            strict(frame, 0)
    lake = Lake(spark, f"{folder}/lake")
    assert not lake.table("shop.x").exists() and not lake.table("ops.ingest_batches").exists()
    for _ in range(2):
        Ingest(spark, f"{folder}/lake", stream_id="s", set_aside=f"{folder}/odd")(frame, 0)
    aside = {r.offset: r.fault for r in spark.read.parquet(f"{folder}/odd").collect()}
    assert aside == {10: envelope.CUT, 11: envelope.NO_OP, 12: envelope.NO_KEY}
    assert spark.read.parquet(f"{folder}/odd").count() == 3
    assert {r.k for r in lake.table("shop.x").current().collect()} == {0, 1, 2} and lake.table("shop.y").current().count() == 1


def test_two_streams_lose_no_metrics_row(spark, folder, monkeypatch):
    """Another stream commits to the metrics table between the rows and the commit of the first."""
    fields = [K, {"field": "a", "type": "int32"}]
    frames = {t: spark.createDataFrame([record(f"pg.shop.{t}", 0, fields, change("c", 1, {"k": 1, "a": 1}), {"k": 1})],
                                       envelope.RAW_SCHEMA) for t in "xy"}
    first, second = (Ingest(spark, f"{folder}/lake", stream_id=s) for s in "xy")
    table, met = first.table("ops.ingest_batches"), []
    real = table.write_folder

    def interleaved(*args, **kwargs):
        out = real(*args, **kwargs)
        if not met:
            met.append(True)
            second(frames["y"], 0)
        return out
    monkeypatch.setattr(table, "write_folder", interleaved)
    first(frames["x"], 0)
    rows = Lake(spark, f"{folder}/lake").table("ops.ingest_batches").current().collect()
    assert met and sorted((r.stream_id, r.table_name) for r in rows) == [("x", "shop.x"), ("y", "shop.y")]
