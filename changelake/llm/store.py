"""Intermediate tables in the cluster's shared folder, and joins to a checked number of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.session import shared_dir

# Ids of at most this many rows are broadcast: 8 bytes each, some 64 MB as a hash table.
BROADCAST_IDS = 1_000_000


# Rows of an Arrow batch: documents are long, and Spark's default of 10,000 would hold tens of MB of text in
# each of several places at once.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches that suit documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once to the shared folder and read from there: its lineage ends here."""
    folder = shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def only_ids(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in the (materialised, distinct) one-column frame ``ids``, or is not
    (``left_anti``): by a broadcast if the ids were counted and are few, else by a shuffled join."""
    name = ids.columns[0]
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    side = ids.withColumnRenamed(name, "_wanted_id")
    return df.join(F.broadcast(side) if few else side, df[key] == F.col("_wanted_id"), how)
