"""Merging changes into a table that is laid out for it: the target is never shuffled.

The table is split into slices by the hash of the key (folders), and within a slice bucketed and sorted by key.
A merge reads the slices that changes touch, joins them bucket by bucket (only the changes are shuffled, to the
target's own buckets), writes these slices anew into a folder of their own, and then points the table at
them slice by slice. Other slices are neither read nor written. A merge that fails before that leaves the table
as it was; one that fails within has switched some slices, and may simply be repeated: rows carry the position
of their last change, and a change that is not newer writes the same row or does nothing.

A key has one row in the target and, after ``latest_per_key``, one change, so no key is hot. The target keeps no
tombstones: for events that arrive after a delete of their row use ``lake.ChangeTable``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.functions.schema import named, quote
from changelake.operators.changes import ORDER_COLUMNS, latest_per_key

SLICE = "_slice"


def slice_of(pks: list[str], slices: int) -> Column:
    return F.pmod(F.xxhash64(*[named(k) for k in pks]), F.lit(slices)).cast("int")


class MergeTarget:
    """A table of the session catalog that takes changes by key."""

    def __init__(self, spark: SparkSession, name: str, path: str, pks: list[str], slices: int = 64, buckets: int = 16):
        self.spark, self.name, self.path = spark, name, path.rstrip("/")
        self.pks, self.slices, self.buckets = list(pks), slices, buckets

    def _write(self, rows: DataFrame, name: str, folder: str) -> None:
        placed = rows.withColumn(SLICE, slice_of(self.pks, self.slices))
        (placed.write.format("parquet").option("compression", "zstd").option("path", folder)
         .partitionBy(SLICE).bucketBy(self.buckets, *self.pks).sortBy(*self.pks).saveAsTable(name))

    def create(self, rows: DataFrame) -> None:
        """Lay out the rows, which have the order columns of changes, one per key."""
        # dealt by bucket first, so that a bucket of a slice is one file
        dealt = rows.repartition(self.buckets, *named(self.pks))
        self._write(dealt, self.name, f"{self.path}/created-{uuid.uuid4().hex[:12]}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop(SLICE)

    def merged(self, changes: DataFrame, touched: list[int]) -> DataFrame:
        """The touched slices after the changes (one per key)."""
        target = self.spark.table(self.name).where(F.col(SLICE).isin(touched)).drop(SLICE)
        t, s = target.alias("t"), changes.withColumn("_hit", F.lit(True)).alias("s")
        of = lambda side, c: F.col(f"{side}.{quote(c)}")
        on = [of("t", k) == of("s", k) for k in self.pks]
        order = lambda side: F.struct(*[F.coalesce(of(side, c), F.lit(0)).cast("long") for c in ORDER_COLUMNS])
        there = of("t", "_cdc_op").isNotNull()
        wins = F.col("s._hit").isNotNull() & (~there | (order("s") >= order("t")))
        return t.join(s, on, "full_outer").where(~(F.coalesce(wins, F.lit(False)) & (of("s", "_cdc_op") == "d"))).select(
            *[F.when(wins, of("s", c)).otherwise(of("t", c)).alias(c) for c in target.columns])

    def merge(self, changes: DataFrame) -> dict:
        """Apply a change frame: its newest change per key inserts, replaces or deletes the row. A change that is
        older than its row does nothing. Returns the slices written."""
        columns = self.rows().columns
        newest = latest_per_key(changes.select(*named(columns)), self.pks)
        # slice numbers: a bounded list, however many changes there are
        touched = sorted(r[0] for r in changes.select(slice_of(self.pks, self.slices)).distinct().collect())
        if not touched:
            return {"slices": 0}
        folder, staged = f"{self.path}/merged-{uuid.uuid4().hex[:12]}", f"{self.name}_{uuid.uuid4().hex[:12]}"
        self._write(self.merged(newest, touched), staged, folder)
        written = {r[0] for r in self.spark.table(staged).select(SLICE).distinct().collect()}
        have = {int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()}
        for n in touched:
            spec = f"PARTITION ({SLICE}={n})"
            if n not in written:                         # every row of the slice is deleted
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {spec}")
            elif n in have:
                self.spark.sql(f"ALTER TABLE {self.name} {spec} SET LOCATION '{folder}/{SLICE}={n}'")
            else:
                self.spark.sql(f"ALTER TABLE {self.name} ADD {spec} LOCATION '{folder}/{SLICE}={n}'")
        self.spark.sql(f"DROP TABLE {staged}")           # the name only: its files are the table's now
        self.spark.catalog.refreshTable(self.name)
        return {"slices": len(touched)}
