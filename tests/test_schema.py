"""Types of event fields, conversions at their limits, schema evolution."""

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.functions import schema as s


def numeric(precision, scale=None):
    made = {s.PARAM_TYPE: "DECIMAL", s.PARAM_LENGTH: str(precision)}
    return {"field": "v", "type": "string", "parameters": made | ({} if scale is None else {s.PARAM_SCALE: str(scale)})}


def temporal(kind, physical="int64"):
    return {"field": "v", "type": physical, "name": f"io.debezium.time.{kind}"}


def one(spark, field, value, ddl):
    """The converted value of one raw value."""
    return spark.createDataFrame([(value,)], f"v {ddl}").select(s.convert(F.col("v"), field).alias("v")).first().v


@pytest.mark.parametrize("precision, scale, expected", [
    (9, 4, T.DecimalType(9, 4)), (38, 38, T.DecimalType(38, 38)), (7, 0, T.DecimalType(7, 0)),
    (39, 2, T.StringType()), (0, 0, T.StringType()), (4, 6, T.StringType()), (20, None, T.StringType())])
def test_exact_numbers_need_usable_bounds(precision, scale, expected):
    assert s.target_type(numeric(precision, scale)) == expected


def test_physical_types_and_unknown_ones():
    got = {t: s.target_type({"field": "v", "type": t}).simpleString() for t in (
        "int8", "int16", "int32", "int64", "float32", "float64", "boolean", "bytes", "string", "array", "map", "new")}
    assert got == {"int8": "int", "int16": "int", "int32": "int", "int64": "bigint", "float32": "float",
                   "float64": "double", "boolean": "boolean", "bytes": "binary", "string": "string", "array": "string",
                   "map": "string", "new": "string"}
    # what is read from JSON is never narrower than what is stored
    assert s.raw_type({"type": "int16"}) == T.LongType() and s.raw_type(numeric(9, 4)) == T.StringType()


@pytest.mark.parametrize("kind, raw, expected", [
    ("Timestamp", 951782400001, datetime(2000, 2, 29, 0, 0, 0, 1000)), ("Timestamp", -1, datetime(1969, 12, 31, 23, 59, 59, 999000)),
    ("Timestamp", 2**62, None), ("Timestamp", -(2**63), None),
    ("MicroTimestamp", -1, datetime(1969, 12, 31, 23, 59, 59, 999999)),
    ("NanoTimestamp", 1999, datetime(1970, 1, 1, 0, 0, 0, 1)), ("NanoTimestamp", -1999, datetime(1969, 12, 31, 23, 59, 59, 999998)),
    ("NanoTimestamp", -(2**63), None)])
def test_instants_at_their_limits(spark, kind, raw, expected):
    assert one(spark, temporal(kind), raw, "long") == expected


@pytest.mark.parametrize("field, raw, ddl, expected", [
    (temporal("Date", "int32"), -719162, "long", date(1, 1, 1)), (temporal("Date", "int32"), 2**40, "long", None),
    ({"field": "v", "type": "int32"}, 2**31, "long", None), ({"field": "v", "type": "int32"}, -(2**31), "long", -(2**31)),
    (numeric(5, 2), "999.99", "string", Decimal("999.99")), (numeric(5, 2), "1000", "string", None),
    (numeric(5, 2), "12,5", "string", None), ({"field": "v", "type": "bytes"}, "%%%", "string", None),
    ({"field": "v", "type": "bytes"}, "AP8=", "string", bytearray(b"\x00\xff")), ({"field": "v", "type": "boolean"}, None, "boolean", None)])
def test_values_that_fit_and_misfits(spark, field, raw, ddl, expected):
    assert one(spark, field, raw, ddl) == expected


def test_nested_values_keep_their_json(spark):
    field = {"field": "v", "type": "map"}
    row = spark.createDataFrame([('{"v": {"q": [1, null]}}',)], "j string").select(
        F.from_json("j", T.StructType([T.StructField("v", s.raw_type(field))])).alias("e")).select(
        s.convert(F.col("e.v"), field).alias("v")).first()
    assert json.loads(row.v) == {"q": [1, None]}


def test_only_lossless_widening():
    narrow, wide = T.DecimalType(6, 3), T.DecimalType(9, 3)
    assert s.can_widen(narrow, wide) and not s.can_widen(wide, narrow) and not s.can_widen(narrow, T.DecimalType(9, 4))
    pairs = {(a, b) for a in (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DateType)
             for b in (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DateType) if s.can_widen(a(), b())}
    assert pairs == {(T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)}


def test_merged_fields_take_the_newest_definition():
    def fields(*names):
        return [dict(zip(("field", "type"), n.split(":"))) for n in names]
    first, second, third = fields("id:int32", "old:string", "x:int32"), fields("id:int32", "x:int64"), fields("y:string", "id:int32", "x:int64")
    merged = s.merge_fields([first, second, third], fields("id:int32"))
    assert [f"{m['field']}:{m['type']}" for m in merged] == ["id:int32", "y:string", "x:int64", "old:string"]
    assert s.merge_fields([], fields("id:int32")) == fields("id:int32")


def test_evolution_never_drops_or_narrows():
    stored = T.StructType.fromDDL("id long, n int, t string, d decimal(6,3)")
    incoming = T.StructType.fromDDL("n long, t double, d decimal(9,3), extra date")
    step = s.evolve(stored, incoming, ["id"])
    assert step.schema == T.StructType.fromDDL("id long, n long, t string, d decimal(9,3), extra date")
    assert len(step.changes) == 3 and [r.split()[0] for r in step.refused] == ["t"]
    same = s.evolve(stored, T.StructType.fromDDL("id long"), ["id"])
    assert same.schema == stored and not same.changes and not same.refused
    assert s.evolve(None, stored, ["id"]).schema == stored


def test_schema_report(spark):
    rows = {r.name: r for r in s.compare_schemas(
        spark, T.StructType.fromDDL("id long, n int, ref int, later string"),
        T.StructType.fromDDL("id long, n int, ref int, dropped string, _cdc_lsn long"), ["id"], ["ref"]).collect()}
    assert [rows[n].status for n in ("id", "n", "ref", "later", "dropped", "_cdc_lsn")] == [
        "synced", "synced", "synced", "pending", "lake only", "metadata"]
    assert [n for n, r in rows.items() if r.widenable] == ["n"] and rows["id"].primary_key and rows["ref"].foreign_key


def test_names_with_quotes():
    assert s.quote("a`b c") == "`a``b c`"
