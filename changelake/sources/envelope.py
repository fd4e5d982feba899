"""Self-describing change events: raw records to typed change frames, and back.

A raw record is (topic, partition, offset, key, value). Key and value are JSON texts of the form
``{"schema":{...},"payload":{...}}``; the value's payload carries op, source position and the
row after the change.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.functions.schema import (
    PARAM_LENGTH, PARAM_SCALE, PARAM_TYPE, convert, from_millis, merge_fields, named, raw_type, target_type)
from changelake.operators.changes import ROW_OPS

log = logging.getLogger(__name__)

# Record schema and the text that separates schema and payload of an envelope.
RAW_SCHEMA = "topic string, partition int, offset long, key string, value string"
PAYLOAD_MARK = ',"payload":'
SCHEMA_MARK = '{"schema":'
# Operations that change no row (truncate, logical message).
OTHER_OPS = ["t", "m"]
# Why a record cannot be applied.
NOT_JSON, CUT, NO_OP, ODD_OP, NO_KEY = (
    "not an envelope", "payload does not parse", "no op", "unknown op", "no key")


@dataclass(frozen=True)
class TopicShape:
    """Row shape of one topic within one batch."""

    topic: str
    fields: list[dict]
    pks: list[str]
    records: int
    ranges: list[tuple[int, int, int]]  # (partition, first offset, last offset)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["field"], target_type(f)) for f in self.fields])


def text_records(raw: DataFrame) -> DataFrame:
    """Drop tombstones and cut key and value into schema text and payload text.

    Cutting is far cheaper than parsing whole records: the schema texts repeat and only the payloads, a
    fraction of each record, are parsed. Records of another layout (spaces, another order of members) are
    parsed as JSON. What is no such JSON keeps its value under ``undecodable``. A payload text that is cut
    in the middle is found by ``decode_all``.
    """
    text = {c: F.col(c).cast("string") for c in ("key", "value")}
    pieces = raw.where(F.col("value").isNotNull()).select(
        "topic", "partition", "offset", *[text[c].alias(f"_{c}_text") for c in text],
        *[F.split(text[c], PAYLOAD_MARK, 2).alias(f"_{c}") for c in text],
        *[text[c].startswith(SCHEMA_MARK).alias(f"_{c}_form") for c in text])

    def piece(column: str, index: int) -> Column:
        whole = F.col(f"_{column}_form") & (F.size(f"_{column}") == 2)
        member = F.get_json_object(f"_{column}_text", ("$.schema", "$.payload")[index])
        # a cut schema text lacks the closing brace of the envelope, so a parsed one gets its opening
        parsed = F.concat(F.lit(SCHEMA_MARK), member) if index == 0 else member
        cut = F.get(f"_{column}", F.lit(index))
        if index:
            # the envelope's own closing brace goes; a record that lacks it must not have a payload that parses
            cut = F.rtrim(cut)
            cut = F.when(cut.endswith("}"), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(
                F.concat(F.lit("{"), cut))
        return F.when(whole, cut).otherwise(parsed)

    cut = pieces.select(
        "topic", "partition", "offset", "_value_text",
        piece("key", 0).alias("key_schema"), piece("key", 1).alias("key_payload"),
        piece("value", 0).alias("value_schema"), piece("value", 1).alias("value_payload"))
    known = F.col("value_schema").isNotNull() & F.col("value_payload").isNotNull()
    return cut.withColumn("undecodable", F.when(~known, F.col("_value_text"))).drop("_value_text")


def parse_schema(text: str) -> dict:
    return json.loads(text + "}")["schema"]


def row_fields(value_schema: dict) -> list[dict]:
    """Field descriptors of the row after the change."""
    return next((f.get("fields", []) for f in value_schema.get("fields", [])
                 if f.get("field") == "after"), [])


def sniff(records: DataFrame) -> list[TopicShape]:
    """Row shape, record count and offset range per topic, from one aggregation.

    Only the distinct schema texts reach the driver. Topics without a message key (no primary
    key) are left out, with a warning.
    """
    found = (records.groupBy("topic", "partition", F.col("value_schema").alias("vs"),
                             F.col("key_schema").alias("ks"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("lo"),
                  F.max("offset").alias("hi")).collect())
    shapes = []
    for topic in sorted({r.topic for r in found}):
        mine = [r for r in found if r.topic == topic]
        keyed = [r for r in mine if r.ks and r.vs]
        if not keyed:
            log.warning("topic %s: none of %d records has a key, the topic is left out", topic, sum(r.n for r in mine))
            continue
        partitions = {r.partition for r in mine}
        if len(partitions) > 1 and len({r.vs for r in keyed}) > 1:
            # offsets of different partitions do not compare: order the schemas by log position
            keyed = schemas_by_position(records.where(F.col("topic") == topic))
        else:
            keyed.sort(key=lambda r: r.hi)
        key_fields = parse_schema(keyed[-1].ks)["fields"]
        fields = merge_fields([row_fields(parse_schema(r.vs)) for r in keyed], key_fields)
        ranges = [(p, min(r.lo for r in mine if r.partition == p),
                   max(r.hi for r in mine if r.partition == p)) for p in sorted(partitions)]
        shapes.append(TopicShape(topic, fields, [f["field"] for f in key_fields],
                                 sum(r.n for r in mine), ranges))
    return shapes


def schemas_by_position(records: DataFrame) -> list:
    """Distinct schema texts of a topic, oldest first by (log position, offset)."""
    lsn = F.get_json_object("value_payload", "$.source.lsn").try_cast("long")
    return (records.where(F.col("value_schema").isNotNull() & F.col("key_schema").isNotNull())
            .groupBy(F.col("value_schema").alias("vs"), F.col("key_schema").alias("ks"))
            .agg(F.max(F.struct(F.coalesce(lsn, F.lit(0)).alias("lsn"), "offset")).alias("last"))
            .orderBy("last").collect())


def decode_all(records: DataFrame, fields: list[dict], pks: list[str],
               table_schema: T.StructType | None = None) -> DataFrame:
    """Typed change frame of one topic, with the records that cannot be applied.

    Key columns come from the message key (a delete has no row after the change), the others
    from the payload. Values are converted to the type of the event and then to the type of
    the table; what does not fit becomes NULL and is counted in ``_rejects``. ``_fault`` says why a
    record cannot be applied. Only operations that change no row are left out.
    """
    struct_of = lambda fs: T.StructType([T.StructField(f["field"], raw_type(f)) for f in fs])
    payload = T.StructType([
        T.StructField("op", T.StringType()),
        T.StructField("source", T.StructType.fromDDL("ts_ms long, lsn long")),
        T.StructField("after", struct_of(fields)), T.StructField("_corrupt", T.StringType())])
    key = struct_of([f for f in fields if f["field"] in pks])
    # the one-element explode keeps the filter on op above the parse; moved below it, every
    # payload would be parsed twice
    corrupt = {"columnNameOfCorruptRecord": "_corrupt"}
    parsed = records.select(
        "topic", "partition", "offset", "key_payload", "value_payload",
        F.explode(F.array(F.from_json("value_payload", payload, corrupt))).alias("e"))
    op = F.col("e.op")
    events = (parsed.where(~F.coalesce(op.isin(OTHER_OPS), F.lit(False)))
              .select("topic", "partition", "offset", "value_payload", "e", F.from_json("key_payload", key).alias("k")))

    types = {f.name: f.dataType for f in table_schema} if table_schema else {}
    columns, rejects, keyless = [], F.lit(0), F.lit(False)
    for f in fields:
        name = f["field"]
        raw = F.col("k").getField(name) if name in pks else F.col("e.after").getField(name)
        value = convert(raw, f)
        stored = types.get(name, target_type(f))
        if stored != target_type(f):
            value = value.try_cast(stored)
        columns.append(value.alias(name))
        if name in pks:
            keyless = keyless | value.isNull()
        if not isinstance(stored, (T.StringType, T.BooleanType)):
            rejects = rejects + (raw.isNotNull() & value.isNull()).cast("int")
    # a value of the wrong type also marks a record as corrupt, but leaves the others, op among them
    fault = (F.when(F.col("value_payload").isNull(), NOT_JSON)
             .when(op.isNull() & F.col("e._corrupt").isNotNull() & (F.col("value_payload") != "null"), CUT)
             .when(op.isNull(), NO_OP)
             .when(~op.isin(ROW_OPS), ODD_OP).when(keyless, NO_KEY))
    return events.select(
        *columns, op.alias("_cdc_op"),
        from_millis(F.col("e.source.ts_ms")).alias("_cdc_source_ts"),
        F.col("e.source.lsn").alias("_cdc_lsn"), F.current_timestamp().alias("_ingested_at"),
        F.col("offset").alias("_offset"), rejects.alias("_rejects"), fault.alias("_fault"),
        F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("value_payload").alias("_payload"))


RECORD_COLUMNS = ["_fault", "_topic", "_partition", "_payload"]


def decode(records: DataFrame, fields: list[dict], pks: list[str],
           table_schema: T.StructType | None = None) -> DataFrame:
    """The changes that can be applied."""
    return decode_all(records, fields, pks, table_schema).where(F.col("_fault").isNull()).drop(*RECORD_COLUMNS)


def faults(decoded: DataFrame) -> DataFrame:
    """topic, partition, offset, fault, value of the records in a frame of ``decode_all`` that cannot be
    applied. (The value is the payload's text; schemas are the topic's.)"""
    return decoded.where(F.col("_fault").isNotNull()).select(
        F.col("_topic").alias("topic"), F.col("_partition").alias("partition"), F.col("_offset").alias("offset"),
        F.col("_fault").alias("fault"), F.col("_payload").alias("value"))


def describe(field: T.StructField) -> dict:
    """Field descriptor of a typed column, the inverse of ``target_type``."""
    def entry(physical: str, **extra) -> dict:
        return {"field": field.name, "type": physical, "optional": True, **extra}

    match field.dataType:
        case T.ByteType() | T.ShortType() | T.IntegerType():
            return entry("int32")
        case T.LongType():
            return entry("int64")
        case T.FloatType():
            return entry("float32")
        case T.DoubleType():
            return entry("float64")
        case T.BooleanType():
            return entry("boolean")
        case T.BinaryType():
            return entry("bytes")
        case T.DateType():
            return entry("int32", name="io.debezium.time.Date")
        case T.TimestampNTZType():
            return entry("int64", name="io.debezium.time.MicroTimestamp")
        case T.TimestampType():
            return entry("string", name="io.debezium.time.ZonedTimestamp")
        case T.DecimalType() as d:
            return entry("string", parameters={PARAM_TYPE: "NUMERIC", PARAM_LENGTH: str(d.precision),
                                               PARAM_SCALE: str(d.scale)})
    return entry("string")


def wire_value(name: str, dtype: T.DataType) -> Column:
    """Typed value to the form it has in the JSON payload."""
    c = named(name)
    match dtype:
        case T.DateType():
            return F.unix_date(c)
        case T.TimestampNTZType():
            return F.unix_micros(c.cast("timestamp"))
        case T.TimestampType():
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        case T.BinaryType():
            return F.base64(c)
        case T.DecimalType():
            return c.cast("string")
    return c


def encode(df: DataFrame, pks: list[str], topic: str, op: Column, offset: Column, lsn: Column,
           ts_ms: Column, partition: Column | None = None) -> DataFrame:
    """Rows to raw records. A delete carries no row after the change."""
    row = [f for f in df.schema if not f.name.startswith("_")]
    descriptors = [describe(f) for f in row]
    compact = lambda obj: json.dumps(obj, separators=(",", ":"))
    value_schema = compact({"type": "struct", "fields": [
        {"type": "struct", "field": "before", "fields": descriptors},
        {"type": "struct", "field": "after", "fields": descriptors},
        {"type": "string", "field": "op"}]})
    key_schema = compact({"type": "struct", "fields": [d for d in descriptors if d["field"] in pks]})
    image = F.struct(*[wire_value(f.name, f.dataType).alias(f.name) for f in row])
    keys = F.struct(*[wire_value(f.name, f.dataType).alias(f.name) for f in row if f.name in pks])
    payload = F.struct(
        F.when(op != "d", image).alias("after"),
        F.struct(ts_ms.cast("long").alias("ts_ms"), lsn.cast("long").alias("lsn")).alias("source"),
        op.alias("op"))
    wrap = lambda schema, body: F.concat(
        F.lit(SCHEMA_MARK + schema + PAYLOAD_MARK), F.to_json(body), F.lit("}"))
    return df.select(
        F.lit(topic).alias("topic"),
        (partition if partition is not None else F.lit(0)).cast("int").alias("partition"),
        offset.cast("long").alias("offset"), wrap(key_schema, keys).alias("key"),
        wrap(value_schema, payload).alias("value"))
