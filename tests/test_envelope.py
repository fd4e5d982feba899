import json

from pyspark.sql import functions as F

from changelake.functions.schema import PARAM_LENGTH, PARAM_SCALE, PARAM_TYPE
from changelake.sources import envelope as env

INT = {"field": "i", "type": "int32"}


def record(topic, offset, fields, payload, key=None, key_fields=None, partition=0):
    key_fields = key_fields or [{"field": "k", "type": "int64"}]
    dump = lambda o: json.dumps(o, separators=(",", ":"))
    schema = {"type": "struct", "fields": [{"field": "before", "fields": fields},
                                           {"field": "after", "fields": fields}]}
    return (topic, partition, offset,
            dump({"schema": {"type": "struct", "fields": key_fields}, "payload": key}) if key else None,
            dump({"schema": schema, "payload": payload}))


def change(op, lsn, after=None):
    return {"op": op, "source": {"ts_ms": 1700000000000, "lsn": lsn}, "after": after}


K = {"field": "k", "type": "int64"}


def test_schema_prefix():
    message = record("t", 0, [INT], change("c", 1, {"i": 1}), {"k": 1})[4]
    prefix = message.split(env.PAYLOAD_MARK, 1)[0]
    assert env.row_fields(env.parse_schema(prefix)) == [INT]
    assert env.row_fields({"fields": [{"field": "op"}]}) == []


def test_mixed_schemas_deletes_and_noise(spark):
    narrow, wide = [K, {"field": "a", "type": "int32"}], [K, {"field": "a", "type": "int64"}, {"field": "n", "type": "string"}]
    rows = [
        record("pg.shop.t", 0, narrow, change("r", 1, {"k": 1, "a": 5}), {"k": 1}),
        record("pg.shop.t", 1, wide, change("u", 2, {"k": 1, "a": 2**33, "n": "x"}), {"k": 1}),
        record("pg.shop.t", 2, wide, change("d", 3), {"k": 2}),
        record("pg.shop.t", 3, wide, change("t", 4), {"k": 3}),       # truncate: ignored
        ("pg.shop.t", 0, 4, None, None),                              # tombstone
        ("pg.shop.t", 0, 5, None, "not an envelope"),
        record("pg.shop.nokey", 6, narrow, change("c", 1, {"k": 1, "a": 1})),
    ]
    raw = env.text_records(spark.createDataFrame(rows, env.RAW_SCHEMA))
    shapes = env.sniff(raw)
    assert [s.topic for s in shapes] == ["pg.shop.t"]  # a topic without a key is left out
    shape = shapes[0]
    assert shape.pks == ["k"] and shape.records == 5 and shape.ranges == [(0, 0, 5)]
    assert [(f.name, f.dataType.simpleString()) for f in shape.schema] == [("k", "bigint"), ("a", "bigint"), ("n", "string")]
    out = env.decode(raw.where("topic = 'pg.shop.t'"), shape.fields, shape.pks).orderBy("_offset").collect()
    assert [(r.k, r.a, r.n, r._cdc_op, r._cdc_lsn) for r in out] == [
        (1, 5, None, "r", 1), (1, 2**33, "x", "u", 2), (2, None, None, "d", 3)]


def test_rejects_are_counted(spark):
    price = {"field": "p", "type": "string", "parameters": {PARAM_TYPE: "NUMERIC", PARAM_LENGTH: "4", PARAM_SCALE: "2"}}
    rows = [record("t.s.t", 0, [K, price, INT], change("c", 1, {"k": 1, "p": "12345.6", "i": 2**40}), {"k": 1}),
            record("t.s.t", 1, [K, price, INT], change("c", 2, {"k": 2, "p": "1.5", "i": None}), {"k": 2})]
    raw = env.text_records(spark.createDataFrame(rows, env.RAW_SCHEMA))
    shape = env.sniff(raw)[0]
    out = env.decode(raw, shape.fields, shape.pks).orderBy("k").collect()
    assert [(r.p, r.i, r._rejects) for r in out][0] == (None, None, 2)
    assert (str(out[1].p), out[1].i, out[1]._rejects) == ("1.50", None, 0)


def test_schemas_of_several_partitions_follow_the_log(spark):
    old, new = [K, {"field": "a", "type": "int32"}], [K, {"field": "a", "type": "int64"}]
    rows = [record("t.s.t", 900, old, change("c", 10, {"k": 1, "a": 1}), {"k": 1}, partition=0),
            record("t.s.t", 3, new, change("c", 20, {"k": 2, "a": 2**40}), {"k": 2}, partition=1)]
    shape = env.sniff(env.text_records(spark.createDataFrame(rows, env.RAW_SCHEMA)))[0]
    assert shape.schema["a"].dataType.simpleString() == "bigint"  # by offset the old one would win


def test_round_trip_of_all_types(spark):
    df = spark.sql("""SELECT 1L AS k, 7 AS i, 1.5D AS f, true AS b, date'1995-01-01' AS d,
        timestamp_ntz'2023-11-14 22:13:20.123456' AS t, timestamp'2026-10-06 08:00:00.5' AS z,
        cast(12.30 as decimal(12,2)) AS p, 'quo"te, ünïcode' AS s, cast('hi' as binary) AS y, cast(null as string) AS n""")
    raw = env.text_records(env.encode(df, ["k"], "pg.shop.x", F.lit("c"), F.lit(3), F.lit(9), F.lit(1700000000000)))
    shape = env.sniff(raw)[0]
    back = env.decode(raw, shape.fields, shape.pks)
    assert [f.dataType for f in back.select(*df.columns).schema] == [f.dataType for f in df.schema]
    assert back.select(*df.columns).collect() == df.collect()


def test_no_cut_record_is_applied(spark):
    """A record cut after any byte, and records that lack a part, are told apart and kept."""
    fields = [K, {"field": "s", "type": "string"}, INT]
    whole = record("pg.shop.t", 0, fields, change("u", 7, {"k": 1, "s": 'br{ace} "quote"', "i": 3}), {"k": 1})
    payload = whole[4].index(env.PAYLOAD_MARK)
    rows = [whole] + [("pg.shop.t", 0, n, whole[3], whole[4][:n]) for n in range(1, len(whole[4]))]
    raw = env.text_records(spark.createDataFrame(rows, env.RAW_SCHEMA))
    shape = env.sniff(raw)[0]
    out = {r._offset: r._fault for r in env.decode_all(raw, shape.fields, shape.pks).collect()}
    assert len(out) == len(rows) and out.pop(0) is None
    assert all(out.values()), [n for n, f in out.items() if f is None]
    assert {out[n] for n in range(payload + len(env.PAYLOAD_MARK) + 2, len(whole[4]))} <= {env.CUT, env.NOT_JSON}


def test_faults_and_values_of_the_wrong_type(spark):
    fields = [K, INT]
    dump = lambda o: json.dumps(o, separators=(",", ":"))
    rows = [record("pg.shop.t", 0, fields, change("c", 1, {"k": 1, "i": "no number"}), {"k": 1}),
            record("pg.shop.t", 1, fields, {"source": {"lsn": 1}, "after": {"k": 2, "i": 1}}, {"k": 2}),
            record("pg.shop.t", 2, fields, change("z", 1, {"k": 3, "i": 1}), {"k": 3}),
            record("pg.shop.t", 3, fields, change("c", 1, {"k": 4, "i": 1}), {"other": 4}),
            record("pg.shop.t", 4, fields, change("c", 1, {"k": 5, "i": 1})),
            record("pg.shop.t", 5, fields, None, {"k": 6}),
            record("pg.shop.t", 6, fields, change("t", 1), None),
            ("pg.shop.t", 0, 7, dump({"payload": {"k": 8}}), "[1, 2]"),
            ("pg.shop.t", 0, 8, None, "")]
    raw = env.text_records(spark.createDataFrame(rows, env.RAW_SCHEMA))
    shape = env.sniff(raw)[0]
    decoded = env.decode_all(raw, shape.fields, shape.pks)
    out = {r._offset: (r._fault, r._rejects) for r in decoded.collect()}
    assert out[0] == (None, 0) or out[0] == (None, 1)
    assert {n: f for n, (f, _) in out.items() if f} == {
        1: env.NO_OP, 2: env.ODD_OP, 3: env.NO_KEY, 4: env.NO_KEY, 5: env.NO_OP, 7: env.NOT_JSON, 8: env.NOT_JSON}
    assert 6 not in out and env.faults(decoded).columns == ["topic", "partition", "offset", "fault", "value"]
