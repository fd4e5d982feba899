"""Streaming sources of raw change records and the input range they may give up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.sources.envelope import RAW_SCHEMA, text_records
from changelake.sources.files import Files

# Topics followed by default, records per trigger, topic discovery interval.
TOPIC_PATTERN = r"pg\.shop\..*"
RECORDS_PER_TRIGGER = 100_000
DISCOVERY_MS = 15_000


def kafka_options(bootstrap: str, pattern: str = TOPIC_PATTERN, cap: int = RECORDS_PER_TRIGGER,
                  tasks: int | None = None) -> dict[str, str]:
    """Options of the Kafka source. ``tasks`` splits topics of few partitions over more tasks."""
    options = {
        "kafka.bootstrap.servers": bootstrap, "subscribePattern": pattern,
        "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(cap),
        "kafka.metadata.max.age.ms": str(DISCOVERY_MS),
    }
    if tasks:
        options["minPartitions"] = str(tasks)
    return options


def raw_source(spark: SparkSession, fmt: str, path: str | None = None,
               options: dict[str, str] | None = None, cap: int | None = None, retain: bool = True) -> DataFrame:
    """A stream of raw records: ``kafka`` (connector on the classpath) or files of them.

    ``cap`` bounds a micro-batch: records for Kafka, files for a folder. Without ``retain`` landed files are
    deleted once the batch that read them has committed (for Kafka see ``streaming.retention``).
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        return (reader.option("maxOffsetsPerTrigger", cap) if cap else reader).load()
    reader = reader.schema(RAW_SCHEMA).option("recursiveFileLookup", "true")
    if not retain:
        reader = reader.option("cleanSource", "delete")
    return (reader.option("maxFilesPerTrigger", cap) if cap else reader).load(path)


def retention_floor(batches: DataFrame) -> DataFrame:
    """Per topic and partition: first offset of the newest batch that read it.

    A batch starts where its predecessor, already committed, ended; records below its first
    offset are never read again. The floor only rises, also for partitions that went quiet.
    ``batches`` has one row per batch and range: topic, partition, batch start offset.
    """
    return (batches.groupBy("topic", "partition").agg(F.max("start_offset").alias("floor"))
            .where(F.col("floor") > 0))


def batch_starts(records: DataFrame, batch: str = "batch_id") -> DataFrame:
    """First offset each batch read from each partition."""
    return (records.groupBy(batch, "topic", "partition")
            .agg(F.min("offset").alias("start_offset")))


def below_floor(records: DataFrame, floor: DataFrame) -> DataFrame:
    """Records that may be deleted."""
    return (records.join(floor, ["topic", "partition"])
            .where(F.col("offset") < F.col("floor")).drop("floor"))


def position_floor(records: DataFrame) -> int | None:
    """The lowest log position among raw records that are still kept: no older event can arrive again, by
    a replay or a late partition. None without records."""
    lsn = F.get_json_object("value_payload", "$.source.lsn").try_cast("long")
    return text_records(records).agg(F.min(lsn)).first()[0]


def trim_landed(spark: SparkSession, folder: str, fmt: str, floor: DataFrame) -> int:
    """Delete landed raw files that hold nothing at or above the floor."""
    raw = (spark.read.format(fmt).schema(RAW_SCHEMA).option("recursiveFileLookup", "true").load(folder)
           .select("topic", "partition", "offset", F.col("_metadata.file_path").alias("file")))
    tops = raw.groupBy("file", "topic", "partition").agg(F.max("offset").alias("top"))
    done = (tops.join(floor, ["topic", "partition"], "left").groupBy("file")
            .agg(F.bool_and(F.coalesce(F.col("top") < F.col("floor"), F.lit(False))).alias("consumed"))
            .where("consumed").select("file"))
    files, removed = Files(spark, folder), 0
    for row in done.toLocalIterator():  # file names only, fetched partition by partition
        removed += bool(files.delete(row.file))
    return removed
