import json
from types import SimpleNamespace

from pyspark.sql import functions as F

from changelake import Lake
from changelake.plans import registry
from changelake.sources import envelope, raw
from changelake.streaming import retention
from changelake.streaming.ingest import run
from tests.conftest import SF
from tests.test_envelope import K, change, record


def progress(start, query="q"):
    return SimpleNamespace(progress=SimpleNamespace(id=query, sources=[SimpleNamespace(startOffset=start)]))


def test_floor_only_rises():
    calls = []
    r = retention.Retention(lambda floor: calls.append(dict(floor)), "q", interval=0)
    report = lambda offsets, query="q": r.onQueryProgress(progress(json.dumps(offsets), query))
    r.onQueryProgress(progress(None))                               # the first batch has no start
    report({"t": {"0": 5, "1": 0}})
    report({"t": {"0": 4}})                                         # nothing to do
    report({"t": {"0": 9}, "u": {"3": 7}})
    report({"t": {"0": 99}}, "another query")
    r.onQueryProgress(progress('{"logOffset": 3}'))                 # a source of files
    r.onQueryProgress(progress("12"))
    assert calls == [{("t", 0): 5}, {("t", 0): 9, ("u", 3): 7}]
    assert r.floor == {("t", 0): 9, ("t", 1): 0, ("u", 3): 7}


def test_failures_and_intervals():
    calls = []

    def delete(floor):
        calls.append(dict(floor))
        if len(calls) == 1:
            raise TimeoutError
    r = retention.Retention(delete, interval=0)
    r.note({("t", 0): 5})
    r.note({})                                                      # tried again though nothing is new
    assert calls == [{("t", 0): 5}] * 2
    slow = retention.Retention(lambda floor: calls.append(floor), interval=3600)
    slow.note({("t", 0): 1})
    slow.note({("t", 0): 2})
    assert calls[2:] == [{("t", 0): 1}] and slow.floor == {("t", 0): 2}


def test_stream_deletes_landed_files_it_has_consumed(spark, folder):
    fields = [K, {"field": "a", "type": "int32"}]

    def land(numbers):
        rows = [record("pg.shop.x", i, fields, change("c", i + 1, {"k": i, "a": i}), {"k": i}) for i in numbers]
        spark.createDataFrame(rows, envelope.RAW_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/raw")

    def go():
        stream = raw.raw_source(spark, "parquet", f"{folder}/raw", cap=1, retain=False)
        run(stream, f"{folder}/lake", f"{folder}/ck", {"availableNow": True}).awaitTermination()
        left = spark.read.schema(envelope.RAW_SCHEMA).parquet(f"{folder}/raw")
        return sorted(r.offset for r in left.select("offset").collect())

    for n in range(3):
        land(range(10 * n, 10 * n + 10))
    assert go() == list(range(20, 30))                              # the newest batch may be repeated
    land(range(30, 40))
    assert go() == list(range(30, 40))
    assert Lake(spark, f"{folder}/lake").table("shop.x").current().count() == 40


def test_position_floor(spark):
    fields = [K]
    rows = [record("pg.shop.x", i, fields, change("c", lsn, {"k": i}), {"k": i}) for i, lsn in enumerate((30, 12, 50))]
    frame = spark.createDataFrame([*rows, ("pg.shop.x", 0, 9, None, None)], envelope.RAW_SCHEMA)
    assert raw.position_floor(frame) == 12 and raw.position_floor(frame.where(F.lit(False))) is None


def test_stage_that_lands_as_many_files_is_one_batch(spark, monkeypatch):
    monkeypatch.setattr(registry, "LANDED_BYTES", 8192)
    caps, real = [], raw.raw_source
    monkeypatch.setattr(raw, "raw_source", lambda *a, **k: caps.append(k["cap"]) or real(*a, **k))
    row = registry.QUERIES["stream_retention"](spark, SF).first()
    keys = range(spark.read.parquet(f"{SF}/orders.parquet").count())
    consumed = sum(1 + (k % 3 == 0) + (k % 10 == 0) + (k % 7 == 0) for k in keys)
    assert caps[0] > 1 and (row.below_floor, row.kept, row.consumed) == (0, sum(k % 7 == 0 for k in keys), consumed)
