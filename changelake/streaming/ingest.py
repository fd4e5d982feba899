"""Continuous ingestion: raw change records into versioned tables, exactly once in effect.

Every micro-batch is split by topic (= table). Per topic the batch is decoded, matched with the
stored schema, reduced to the newest change per key and committed as one change set. A batch
replayed after a crash finds its own commit and changes nothing.
"""

from __future__ import annotations

import logging
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from changelake.lake import ChangeTable, CommitConflict, Lake
from changelake.operators.changes import latest_per_key
from changelake.session import prepare
from changelake.sources.envelope import NOT_JSON, RECORD_COLUMNS, TopicShape, decode_all, faults, sniff, text_records

log = logging.getLogger(__name__)

METRICS_TABLE = "ops.ingest_batches"
METRICS_ATTEMPTS = 20
METRICS_KEY = ["stream_id", "batch_id", "table_name"]
METRICS_SCHEMA = T.StructType([
    T.StructField("stream_id", T.StringType()), T.StructField("batch_id", T.LongType()),
    T.StructField("table_name", T.StringType()), T.StructField("kafka_records", T.LongType()),
    T.StructField("rows_merged", T.LongType()), T.StructField("inserts", T.LongType()),
    T.StructField("updates", T.LongType()), T.StructField("deletes", T.LongType()),
    T.StructField("merge_ms", T.LongType()), T.StructField("batch_started_at", T.TimestampType()),
    T.StructField("batch_finished_at", T.TimestampType()),
    T.StructField("schema_changes", T.StringType()), T.StructField("cast_rejects", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("ranges", T.ArrayType(T.StructType([
        T.StructField("partition", T.IntegerType()), T.StructField("start_offset", T.LongType()),
        T.StructField("end_offset", T.LongType())])))])


class Ingest:
    """The ``foreachBatch`` function of an ingestion stream."""

    def __init__(self, spark: SparkSession, root: str, parallel_tables: int = 4,
                 stream_id: str | None = None, set_aside: str | None = None):
        """``set_aside``: a folder for records that cannot be applied, each with the reason. Without it they
        stop the stream: what is no envelope before any of its batch is committed, others before their
        table's commit. A restart repeats the batch; tables that have it already skip it."""
        self.set_aside = set_aside
        self.spark, self.lake = prepare(spark), Lake(spark, root)
        self.parallel_tables, self.stream_id = parallel_tables, stream_id
        self._tables: dict[str, ChangeTable] = {}
        # table -> (incoming schema, stored schema) of the last batch: an unchanged incoming
        # schema needs no comparison
        self._seen: dict[str, tuple[T.StructType, T.StructType]] = {}

    def table(self, name: str) -> ChangeTable:
        return self._tables.setdefault(name, self.lake.table(name))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        started = datetime.now(timezone.utc)
        stream = self.stream_id or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        records = text_records(batch).persist()
        try:
            self._undecodable(records, stream, batch_id)
            shapes = sniff(records)
            good = records.where(F.col("undecodable").isNull())
            work = [(s, good.where(F.col("topic") == s.topic)) for s in shapes]
            stats = self._fan_out(work, stream, batch_id)
        finally:
            records.unpersist()
        self._record(stats, stream, batch_id, started)

    def _undecodable(self, records: DataFrame, stream: str, batch_id: int) -> None:
        bad = records.where(F.col("undecodable").isNotNull()).select(
            "topic", "partition", "offset", F.lit(NOT_JSON).alias("fault"), F.col("undecodable").alias("value"))
        if not bad.isEmpty():
            self._put_aside(bad, stream, batch_id, "envelope")

    def _put_aside(self, bad: DataFrame, stream: str, batch_id: int, part: str) -> None:
        if not self.set_aside:
            first = bad.orderBy("topic", "partition", "offset").first()
            raise ValueError(f"batch {batch_id}: {bad.count()} records cannot be applied, the first at "
                             f"{first.topic}/{first.partition}/{first.offset} ({first.fault}); give set_aside to go "
                             f"on without them")
        # overwritten by a replay of the batch, so each record is there once
        bad.write.mode("overwrite").parquet(f"{self.set_aside}/stream={stream}/batch={batch_id}/part={part}")

    def _fan_out(self, work: list, stream: str, batch_id: int) -> list[dict]:
        """Tables are independent: their jobs run side by side."""
        job = lambda w: self.ingest_table(*w, stream, batch_id)
        if len(work) <= 1 or self.parallel_tables <= 1:
            done = [job(w) for w in work]
        else:
            with ThreadPoolExecutor(min(self.parallel_tables, len(work))) as pool:
                done = list(pool.map(job, work))
        return [d for d in done if d]

    def ingest_table(self, shape: TopicShape, records: DataFrame, stream: str, batch_id: int) -> dict | None:
        name = shape.topic.split(".", 1)[1]
        table = self.table(name)
        if table.applied(stream, batch_id):
            log.info("batch %d of %s is already applied", batch_id, name)
            return None
        incoming, seen = shape.schema, self._seen.get(name)
        if seen and seen[0] == incoming and table.head().schema_json == seen[1].json():
            schema, changes = seen[1], []
        else:
            evolution = table.evolved(incoming, shape.pks)
            schema, changes = evolution.schema, evolution.changes
            for step in evolution.refused:
                log.warning("%s: cannot widen %s; values are cast to the stored type", name, step)
        begun = time.perf_counter()
        counted = Observation()
        decoded = decode_all(records, shape.fields, shape.pks, schema)
        good = F.col("_fault").isNull()
        # counted in the pass that writes the changes; a second one reads the faults only if there are any
        typed = decoded.observe(counted, F.coalesce(F.sum(F.when(good, F.col("_rejects"))), F.lit(0)).alias("rejects"),
                                F.count_if(~good).alias("faults")).where(good)

        def before_commit() -> None:
            if counted.get["faults"]:
                self._put_aside(faults(decoded), stream, batch_id, name)

        newest = latest_per_key(typed.drop("_rejects", *RECORD_COLUMNS), shape.pks)
        _, stats = table.append(newest, schema, shape.pks, stream, batch_id, before_commit)
        self._seen[name] = (incoming, schema)
        if not stats["rows"] and not changes:
            return None
        return {"table_name": name, "kafka_records": shape.records, "rows_merged": stats["rows"],
                "inserts": stats["inserts"], "updates": stats["updates"], "deletes": stats["deletes"],
                "merge_ms": int((time.perf_counter() - begun) * 1000),
                "schema_changes": "; ".join(changes) or None,
                "cast_rejects": counted.get["rejects"], "topic": shape.topic, "ranges": shape.ranges}

    def _record(self, stats: list[dict], stream: str, batch_id: int, started: datetime) -> None:
        """One metrics row per table. Streams share the metrics table: a commit that meets another stream's is
        tried again on top of it. The data is committed, so a failure here is only logged."""
        if not stats:
            return
        common = {"stream_id": stream, "batch_id": batch_id, "batch_started_at": started,
                  "batch_finished_at": datetime.now(timezone.utc)}
        rows = [tuple({**common, **s}[f.name] for f in METRICS_SCHEMA) for s in stats]
        try:
            frame = (self.spark.createDataFrame(rows, METRICS_SCHEMA)
                     .withColumns({"_cdc_op": F.lit("c"), "_cdc_source_ts": F.col("batch_finished_at"),
                                   "_cdc_lsn": F.col("batch_id"), "_ingested_at": F.current_timestamp(),
                                   "_offset": F.lit(0).cast("long")}))
            for attempt in range(METRICS_ATTEMPTS):
                try:
                    self.table(METRICS_TABLE).append(frame.coalesce(1), METRICS_SCHEMA, METRICS_KEY)
                    break
                except CommitConflict:
                    if attempt == METRICS_ATTEMPTS - 1:
                        raise
        except Exception:  # noqa: BLE001
            log.warning("batch %d: metrics not recorded", batch_id, exc_info=True)


def run(raw_stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
        query_name: str = "changelake_ingest", parallel_tables: int = 4) -> StreamingQuery:
    """Start the ingestion of a raw stream into the tables below ``root``.

    ``trigger`` as for ``writeStream.trigger``; the default starts a batch every 10 seconds.
    """
    ingest = Ingest(raw_stream.sparkSession, root, parallel_tables)
    return (raw_stream.writeStream.queryName(query_name).foreachBatch(ingest)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def batch_ranges(metrics: DataFrame) -> DataFrame:
    """Input ranges of every batch, as ``raw.retention_floor`` takes them."""
    return (metrics.select("batch_id", "topic", F.explode("ranges").alias("r"))
            .select("batch_id", "topic", "r.partition", "r.start_offset", "r.end_offset"))
