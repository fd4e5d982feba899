"""Versioned tables: a folded base data set, change sets beside it and a log of commits.

    <root>/<namespace>/<table>/base/version=V/...      folded rows (may be split by month)
    <root>/<namespace>/<table>/changes/version=N/...   one row per key touched by commit N
    <root>/<namespace>/<table>/tombstones/version=V/   digest and position of each key deleted by then
    <root>/<namespace>/<table>/commits/N.json          what version N consists of

Readers only open folders that a commit names, so unfinished writes stay invisible. All row
work is DataFrame work; the driver handles commit records only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.functions.schema import META, META_FIELDS, Evolution, evolve, named
from changelake.operators import versions as ops
from changelake.operators.changes import alive, change_order, fold, latest_per_key
from changelake.session import SMALL_SIDE_BYTES, is_small
from changelake.sources.files import Files

INTERNAL_FIELDS = [T.StructField("_offset", T.LongType()), T.StructField("_version", T.LongType())]
SYSTEM = [*META, *[f.name for f in INTERNAL_FIELDS]]

LOG_SCHEMA = (
    "version long, parent long, committed_at timestamp, operation string, "
    "streams map<string,long>, schema_id int, schema_json string, pks array<string>, "
    "properties map<string,string>, base_version long, base_paths array<string>, "
    "change_paths array<string>, tombstone_paths array<string>, base_high array<long>, changes_low array<long>, "
    "high array<long>, base_rows long, change_rows long, key_bytes long, "
    "summary map<string,string>")


class VersionExpired(LookupError):
    """The requested version is no longer kept."""


class CommitConflict(RuntimeError):
    """Another writer published the version first. A table has one writer at a time: the step failed as a
    whole, its folder is named by no commit, and a stream that is started again repeats its batch."""


@dataclass(frozen=True)
class Commit:
    """One version of a table. ``*_high`` / ``*_low`` are (log position, offset, version)."""

    version: int
    parent: int | None
    committed_at: str
    operation: str
    schema_json: str
    pks: list[str]
    streams: dict = field(default_factory=dict)  # stream id -> newest micro-batch applied
    schema_id: int = 0
    properties: dict = field(default_factory=dict)
    base_version: int | None = None
    base_paths: list = field(default_factory=list)
    change_paths: list = field(default_factory=list)
    base_high: list | None = None
    changes_low: list | None = None
    high: list | None = None
    base_rows: int = 0
    change_rows: int = 0
    key_bytes: int = 0
    tombstone_paths: list = field(default_factory=list)
    tombstone_rows: int = 0
    summary: dict = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema_json))

    @property
    def month_column(self) -> str | None:
        return self.properties.get("month_column")

    @property
    def in_order(self) -> bool:
        """True when every change is newer than every row of the base."""
        return not self.base_high or not self.changes_low or self.changes_low > self.base_high


# A tombstone as it is stored: the key only as a digest, so an erased subject's key is not kept either.
TOMBSTONE = T.StructType([T.StructField("_key", T.BinaryType()), T.StructField("_cdc_lsn", T.LongType()),
                          T.StructField("_offset", T.LongType()), T.StructField("_version", T.LongType())])
SCANS_KEPT = 8
TOMBSTONE_BYTES = 100                                    # of one in a hash table


def key_digest(pks: list[str]) -> Column:
    """SHA-256 of a key's columns, each with its length, so that no two keys share a text."""
    parts = [F.concat(F.length(named(k).cast("string")).cast("string"), F.lit(":"), named(k).cast("string")) for k in pks]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(p, F.lit("-")) for p in parts]), 256))


def data_paths() -> Column:
    """All folders that a commit of the log names."""
    none = F.array().cast("array<string>")
    return F.concat("base_paths", "change_paths", F.coalesce("tombstone_paths", none))


def utc_text(moment: datetime | None = None) -> str:
    return (moment or datetime.now(timezone.utc)).isoformat(timespec="microseconds")


def measures(pks: list[str]) -> list[Column]:
    """Aggregates observed while a change set or base is written."""
    key_size = reduce(lambda a, b: a + b, [
        F.coalesce(F.octet_length(named(k).cast("string")), F.lit(0)) + 16 for k in pks])
    order = F.struct(F.coalesce("_cdc_lsn", F.lit(0)), F.coalesce("_offset", F.lit(0)), F.col("_version"))
    op = F.col("_cdc_op")
    return [F.count(F.lit(1)).alias("rows"), F.sum(key_size.cast("long")).alias("key_bytes"),
            F.min(order).alias("low"), F.max(order).alias("high"),
            F.count_if(op.isin("c", "r")).alias("inserts"), F.count_if(op == "u").alias("updates"),
            F.count_if(op == "d").alias("deletes")]


class ChangeTable:
    """One versioned table."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, name
        self.path = f"{root.rstrip('/')}/{name.replace('.', '/', 1)}"
        self.files = Files(spark, root)
        self._head: Commit | None = None
        self._scans: dict[tuple, DataFrame] = {}

    # ---- commit log -------------------------------------------------------------------
    def _commit_file(self, version: int) -> str:
        return f"{self.path}/commits/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/commits")]

    def exists(self) -> bool:
        return self._head is not None or bool(self.versions())

    def head(self) -> Commit:
        """Newest commit. A cached head stays valid while it is kept and has no successor.

        (When maintenance elsewhere has also expired the successor, the cached one is gone too.)
        """
        here = lambda v: self.files.exists(self._commit_file(v))
        if self._head and not here(self._head.version + 1) and here(self._head.version):
            return self._head
        found = self.versions()
        if not found:
            raise LookupError(f"table {self.name} does not exist")
        self._head = self.commit_at(found[-1])
        return self._head

    def commit_at(self, version: int) -> Commit:
        path = self._commit_file(version)
        if not self.files.exists(path):
            raise VersionExpired(f"{self.name}: version {version} is not kept")
        return Commit(**json.loads(self.files.read_text(path)))

    def publish(self, commit: Commit) -> Commit:
        if not self.files.write_new(self._commit_file(commit.version), json.dumps(asdict(commit))):
            raise CommitConflict(f"{self.name}: version {commit.version} already exists")
        self._head = commit
        return commit

    def log(self) -> DataFrame:
        """The commit log as a DataFrame."""
        return self.spark.read.schema(LOG_SCHEMA).json(f"{self.path}/commits")

    def applied(self, stream_id: str, batch_id: int) -> bool:
        """True when a commit already holds this micro-batch (a replay after a crash)."""
        return self.exists() and self.head().streams.get(stream_id, -1) >= batch_id

    def properties(self) -> DataFrame:
        """Table properties: primary key, layout, schema id."""
        head = self.head()
        layout = head.properties.get("layout", {})
        rows = [("primary-key", ",".join(head.pks)), ("schema-id", str(head.schema_id)),
                ("sort-order", layout.get("sort_by")), ("month-column", layout.get("month_column"))]
        return self.spark.createDataFrame([r for r in rows if r[1]], "key string, value string")

    # ---- reading ----------------------------------------------------------------------
    def _file_schema(self, commit: Commit) -> T.StructType:
        return T.StructType([*commit.schema.fields, *META_FIELDS, *INTERNAL_FIELDS])

    def read_paths(self, commit: Commit, paths: list[str], partitioned: bool = False) -> DataFrame:
        """Rows of some folders under the evolved schema, with the month column if there is one."""
        schema = self._file_schema(commit)
        month = commit.month_column
        if not paths:
            frame = self.spark.createDataFrame([], schema)
            return frame.withColumn(month, F.lit(None).cast("string")) if month else frame
        columns = [f.name for f in schema]
        if partitioned and month:
            schema = T.StructType([*schema.fields, T.StructField(month, T.StringType())])
            columns.append(month)
        frame = self._scan(tuple(paths), schema).select(*named(columns))
        if month and not partitioned:
            frame = frame.withColumn(month, month_of(named(commit.properties["month_source"])))
        return frame

    def _scan(self, paths: tuple[str, ...], schema: T.StructType) -> DataFrame:
        """A scan of folders. What a commit names never changes, so the newest scans are kept: a query over a
        version that was read before lists no files again."""
        key = (paths, schema.json())
        found = self._scans.pop(key, None)
        if found is None:
            found = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{p}" for p in paths])
        self._scans[key] = found
        while len(self._scans) > SCANS_KEPT:
            self._scans.pop(next(iter(self._scans)))
        return found

    def base(self, commit: Commit) -> DataFrame:
        return self.read_paths(commit, commit.base_paths, partitioned=True)

    def changes(self, commit: Commit) -> DataFrame:
        return self.read_paths(commit, commit.change_paths)

    def touched_keys(self, commit: Commit) -> DataFrame:
        """Keys with changes; broadcast only while the measured key bytes are small."""
        keys = self.changes(commit).select(*named(commit.pks)).distinct()
        return F.broadcast(keys) if commit.key_bytes <= SMALL_SIDE_BYTES else keys

    def tombstones(self, commit: Commit) -> DataFrame:
        """Digests and positions of the keys that are deleted as of the base."""
        if not commit.tombstone_paths:
            return self.spark.createDataFrame([], TOMBSTONE)
        return self.spark.read.schema(TOMBSTONE).parquet(*[f"{self.path}/{p}" for p in commit.tombstone_paths])

    def unbeaten(self, changes: DataFrame, commit: Commit) -> DataFrame:
        """The changes that are newer than their key's tombstone, or whose key has none."""
        if not commit.tombstone_paths:
            return changes
        dead = self.tombstones(commit).select(F.col("_key").alias("_dead"), change_order(TOMBSTONE.names).alias("_since"))
        if commit.tombstone_rows * TOMBSTONE_BYTES <= SMALL_SIDE_BYTES:
            dead = F.broadcast(dead)
        met = changes.join(dead, key_digest(commit.pks) == F.col("_dead"), "left")
        newer = F.col("_since").isNull() | (change_order(changes.columns) > F.col("_since"))
        return met.where(newer).select(*named(changes.columns))

    def state(self, commit: Commit) -> DataFrame:
        """Rows of a version, system columns included.

        Rows without changes come straight from the base scan, so filters and column pruning
        reach it and it is not shuffled while the change set is small.
        """
        pks = commit.pks
        if not commit.change_paths:
            return self.base(commit)
        changes = self.changes(commit)
        if not commit.base_paths:
            return fold([self.unbeaten(changes, commit)], pks)
        if not commit.in_order:
            # late changes may be older than a delete that compaction has folded away
            changes = self.unbeaten(changes, commit)
        keys = self.touched_keys(commit)
        untouched = self.base(commit).join(keys, pks, "left_anti")
        if commit.in_order:
            return untouched.unionByName(alive(latest_per_key(changes, pks)))
        # late changes: the base rows of these keys take part in the fold
        touched = self.base(commit).join(keys, pks, "left_semi")
        return untouched.unionByName(fold([touched, changes], pks))

    def _visible(self, df: DataFrame, commit: Commit, system: bool) -> DataFrame:
        names = [f.name for f in commit.schema]
        return df.select(*named([*names, *(SYSTEM if system else META)]))

    def current(self, system: bool = False) -> DataFrame:
        """The table as of the newest commit."""
        head = self.head()
        return self._visible(self.state(head), head, system)

    def scan_range(self, column: str, lo: str, hi: str) -> DataFrame:
        """Current rows with ``column`` in the half-open range [lo, hi), pruning months."""
        head = self.head()
        rows = month_range(self.state(head), column, lo, hi, head.month_column
                           if head.properties.get("month_source") == column else None)
        return self._visible(rows, head, False)

    def resolve(self, version: int | None = None, timestamp: str | None = None) -> Commit:
        if version is None:
            found = self.log().where(F.col("committed_at") <= F.lit(timestamp).cast("timestamp")) \
                        .agg(F.max("version").alias("v")).first().v
            if found is None:
                raise VersionExpired(f"{self.name}: nothing kept from {timestamp} or before")
            version = found
        return self.commit_at(version)

    def as_of(self, version: int | None = None, timestamp: str | None = None,
              system: bool = False) -> DataFrame:
        """The table as it was at a version or a time."""
        commit = self.resolve(version, timestamp)
        return self._visible(self.state(commit), commit, system)

    # ---- history ----------------------------------------------------------------------
    def snapshots(self, limit: int = 60) -> DataFrame:
        """Newest commits with their counters."""
        counters = ["rows-written", "rows-deleted", "files-written", "files-dropped", "rows-total", "base-files",
                    "change-files"]
        return (self.log().orderBy(F.desc("version")).limit(limit)
                .select("committed_at", "version", "parent", "operation",
                        *[F.try_element_at("summary", F.lit(c)).alias(c.replace("-", "_"))
                          for c in counters]))

    def schema_log(self, limit: int = 20) -> DataFrame:
        """Commits that changed the schema, newest first (the log is metadata, a row per commit)."""
        from pyspark.sql import Window
        w = Window.partitionBy(F.lit(self.name)).orderBy("version")
        return (self.log().select("version", "committed_at", "schema_id", "schema_json")
                .withColumn("_before", F.lag("schema_id").over(w))
                .where(~F.col("schema_id").eqNullSafe(F.col("_before"))).drop("_before")
                .orderBy(F.desc("version")).limit(limit))

    def version_stats(self, version: int) -> DataFrame:
        """Rows then, rows now and current rows changed since, per operation."""
        then = self.as_of(version).agg(F.count(F.lit(1))).scalar()
        now = self.current().agg(F.count(F.lit(1))).scalar()
        by_op = ops.changed_since(self.current(system=True), version)
        entries = by_op.agg(F.map_from_entries(F.collect_list(
            F.struct("_cdc_op", "rows_changed")))).scalar()  # at most one entry per operation
        return self.spark.range(1).select(F.lit(version).cast("long").alias("version"),
                                          then.alias("rows_then"), now.alias("rows_now"),
                                          entries.alias("changed_since"))

    def kept_changes(self, oldest: Commit, newest: Commit) -> DataFrame:
        """The base of one version and every kept change up to another, as one change frame."""
        found = (self.log().where(F.col("version").between(oldest.version, newest.version))
                 .select(F.explode("change_paths").alias("path")).distinct().collect())
        paths = sorted(r.path for r in found)
        frame = self.unbeaten(self.read_paths(newest, paths), oldest)
        names = named(self._file_schema(newest).names)
        if not oldest.base_paths:
            return frame.select(*names)
        old_base = replace(newest, properties=oldest.properties, base_paths=oldest.base_paths)
        return self.base(old_base).select(*names).unionByName(frame.select(*names))

    def rebuilds(self, after: int, upto: int) -> list[int]:
        """Versions in (after, upto] at which the table was built anew: earlier changes end there."""
        found = self.log().where((F.col("operation") == "overwrite") & F.col("version").between(after + 1, upto))
        return sorted(r.version for r in found.select("version").collect())  # a few per table

    def changed_keys(self, after: int = -1) -> DataFrame:
        """The keys that a kept change set of a version later than ``after`` touches."""
        newest = self.head()
        found = (self.log().where(F.col("version") > after).select(F.explode("change_paths").alias("path")).distinct().collect())
        rows = self.read_paths(newest, sorted(r.path for r in found)).where(F.col("_version") > after)
        return rows.select(*named(newest.pks)).distinct()

    def row_history(self, keys: list | DataFrame, depth: int = 12) -> DataFrame:
        """The rows of some keys at each of the newest ``depth`` versions, newest first. A key is a value, or
        with a composite primary key a tuple of all its columns; many keys are a frame of the key columns."""
        newest = self.head()
        if isinstance(keys, DataFrame):
            wanted = keys.select(*named(newest.pks)).distinct()
            wanted = F.broadcast(wanted) if is_small(wanted) else wanted
        else:
            rows = [k if isinstance(k, (tuple, list)) else (k,) for k in keys]
            if any(len(k) != len(newest.pks) for k in rows):
                raise ValueError(f"{self.name}: a key has the columns {newest.pks}")
            types = {f.name: f.dataType for f in newest.schema}
            key_schema = T.StructType([T.StructField(c, types[c]) for c in newest.pks])
            wanted = F.broadcast(self.spark.createDataFrame([tuple(k) for k in rows], key_schema).distinct())
        listed = self.versions()[-depth:]
        cuts = [listed[0], *self.rebuilds(listed[0], listed[-1]), listed[-1] + 1]
        parts = []
        for begin, end in zip(cuts, cuts[1:]):
            part = [v for v in listed if begin <= v < end]
            frame = self.kept_changes(self.commit_at(part[0]), self.commit_at(part[-1]))
            found = ops.row_history(frame.join(wanted, newest.pks, "left_semi"), newest.pks, part)
            # parts have the row under the schema of their time
            parts.append(self._as_newest(found, newest) if len(cuts) > 2 else found)
        return reduce(lambda a, b: a.unionByName(b), parts).orderBy(*named(newest.pks), F.desc("version"))

    def _as_newest(self, history: DataFrame, newest: Commit) -> DataFrame:
        have = {f.name for f in history.schema["row"].dataType}
        fields = [f for f in self._file_schema(newest).fields if f.name not in [*newest.pks]]
        row = F.struct(*[(F.col("row")[f.name].try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
                         .alias(f.name) for f in fields])
        return history.withColumn("row", F.when(F.col("row").isNotNull(), row))

    def diff(self, older: int, newer: int) -> DataFrame:
        """Inserted, updated and deleted rows between two versions."""
        a, b = self.commit_at(older), self.commit_at(newer)
        if self.rebuilds(older, newer):
            # no chain of changes leads across a rebuild: compare the two states
            return self._diff_of_states(a, b)
        frame = self.kept_changes(a, b)
        # only keys changed in between can differ; the others leave before the aggregation
        moved = frame.where(F.col("_version") > older).select(*named(b.pks)).distinct()
        touched = frame.join(moved, b.pks, "left_semi")
        return ops.diff(touched, b.pks, older, newer)

    def _diff_of_states(self, a: Commit, b: Commit) -> DataFrame:
        """The same with every row of the older state taken as its version's change, and of the newer one."""
        fields = self._file_schema(b).fields

        def rows(commit: Commit, op: Column, version: int) -> DataFrame:
            state = self.state(commit)
            have = set(state.columns)
            return state.select(*[(F.lit(version).cast("long") if f.name == "_version" else F.lit(version).cast("long")
                                   if f.name in ("_cdc_lsn", "_offset") else op if f.name == "_cdc_op"
                                   else named(f.name).try_cast(f.dataType) if f.name in have
                                   else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])

        old, new = rows(a, F.lit("r"), a.version), rows(b, F.lit("r"), b.version)
        gone = old.join(new.select(*named(b.pks)), b.pks, "left_anti").withColumns({
            "_cdc_op": F.lit("d"), "_version": F.lit(b.version).cast("long"), "_cdc_lsn": F.lit(b.version).cast("long"),
            "_offset": F.lit(b.version).cast("long")}).select(*named([f.name for f in fields]))
        return ops.diff(old.unionByName(new).unionByName(gone), b.pks, a.version, b.version)

    # ---- writing ----------------------------------------------------------------------
    def next_version(self) -> int:
        return self.head().version + 1 if self.exists() else 0

    def write_folder(self, df: DataFrame, kind: str, version: int | str, pks: list[str],
                     partition_by: str | None = None, key_filters: bool = False) -> tuple[str, dict]:
        """Write one base or change folder and return its relative path and measures."""
        seen = Observation()
        # a folder of its own for every write: no writer can touch what another one has written
        path = f"{kind}/version={version}-{uuid.uuid4().hex[:12]}"
        writer = df.observe(seen, *measures(pks)).write.option("compression", "zstd")
        if key_filters:
            # key lookups skip row groups by Bloom filter, whatever column the rows are sorted by
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
            for key in pks:
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.path}/{path}")
        stats = dict(seen.get)
        for bound in ("low", "high"):
            stats[bound] = list(stats[bound]) if stats.get(bound) else None
        stats["files"], stats["bytes"] = self.files.usage(f"{self.path}/{path}")
        return path, stats

    def bootstrap(self, df: DataFrame, pks: list[str], lsn: int = 0) -> Commit:
        """(Re)build the table from a full source snapshot: a new base, no changes."""
        version = self.next_version()
        parent = self.head() if self.exists() else None
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema
                               if f.name not in SYSTEM])
        rows = df.select(*named(schema.names), F.lit("r").alias("_cdc_op"),
                         F.current_timestamp().alias("_cdc_source_ts"),
                         F.lit(lsn).cast("long").alias("_cdc_lsn"),
                         F.current_timestamp().alias("_ingested_at"),
                         F.lit(0).cast("long").alias("_offset"),
                         F.lit(version).cast("long").alias("_version"))
        path, stats = self.write_folder(rows, "base", version, pks, key_filters=True)
        same = parent is not None and parent.schema_json == schema.json()
        schema_id = 0 if parent is None else parent.schema_id + (0 if same else 1)
        return self.publish(Commit(
            version, parent.version if parent else None, utc_text(), "overwrite", schema.json(), pks,
            streams=parent.streams if parent else {}, schema_id=schema_id, base_version=version, base_paths=[path],
            base_high=stats["high"], high=stats["high"], base_rows=stats["rows"],
            summary=self._summary(stats, None, stats["rows"], stats["files"], 0)))

    @staticmethod
    def _summary(stats: dict, removed_files: int | None, total: int, data_files: int,
                 change_files: int) -> dict:
        return {k: str(v) for k, v in {
            "rows-written": (stats.get("inserts") or 0) + (stats.get("updates") or 0),
            "rows-deleted": stats.get("deletes") or 0,
            "files-written": stats.get("files") or 0, "files-dropped": removed_files or 0,
            "rows-total": total, "base-files": data_files, "change-files": change_files}.items()}

    def evolved(self, incoming: T.StructType, pks: list[str]) -> Evolution:
        """The stored schema extended by an incoming one."""
        return evolve(self.head().schema if self.exists() else None, incoming, pks)

    def append(self, changes: DataFrame, schema: T.StructType, pks: list[str],
               stream_id: str | None = None, batch_id: int | None = None,
               before_commit: Callable[[], None] | None = None) -> tuple[Commit, dict]:
        """Commit one change set: typed rows, one per key, with the metadata columns. ``before_commit`` runs
        when the rows are written; if it raises, nothing is committed."""
        version = self.next_version()
        parent = self.head() if self.exists() else Commit(-1, None, "", "", "", pks, schema_id=-1)
        have = set(changes.columns)
        cols = [named(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                for f in [*schema.fields, *META_FIELDS, INTERNAL_FIELDS[0]]]
        path, stats = self.write_folder(
            changes.select(*cols, F.lit(version).cast("long").alias("_version")),
            "changes", version, pks)
        if before_commit:
            before_commit()
        if not stats["rows"] and parent.schema_json == schema.json():
            return parent, stats
        known = parent.schema_json == schema.json()
        lows = [x for x in (parent.changes_low, stats["low"]) if x]
        highs = [x for x in (parent.high, stats["high"]) if x]
        total = parent.base_rows + parent.change_rows + stats["rows"]
        change_files = int(parent.summary.get("change-files", 0)) + stats["files"]
        commit = replace(
            parent, version=version, parent=parent.version if parent.version >= 0 else None,
            committed_at=utc_text(), operation="append", schema_json=schema.json(), pks=pks,
            streams={**parent.streams, stream_id: batch_id} if stream_id else parent.streams,
            schema_id=parent.schema_id + (0 if known else 1),
            change_paths=[*parent.change_paths, *([path] if stats["rows"] else [])],
            changes_low=min(lows) if lows else None, high=max(highs) if highs else None,
            change_rows=parent.change_rows + stats["rows"],
            key_bytes=parent.key_bytes + (stats["key_bytes"] or 0),
            summary=self._summary(stats, 0, total,
                                  int(parent.summary.get("base-files", 0)), change_files))
        return self.publish(commit), stats

    def erase(self, predicate: Column) -> tuple[Commit, dict]:
        """Commit delete changes for every current row that matches."""
        head = self.head()
        lsn, offset = (head.high or [0, 0, 0])[:2]
        rows = self.current().where(predicate)
        deletes = ops.erase_changes(rows, head.pks, F.lit(lsn), F.current_timestamp()) \
                     .withColumn("_offset", F.lit(offset).cast("long"))
        return self.append(deletes, head.schema, head.pks)


def month_of(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def month_range(df: DataFrame, column: str, lo: str, hi: str, month: str | None) -> DataFrame:
    """Filter [lo, hi) on a date column; with a month column the folders are pruned as well."""
    lower, upper = F.lit(lo).cast("date"), F.lit(hi).cast("date")
    out = df.where((F.col(column) >= lower) & (F.col(column) < upper))
    if month:
        out = out.where(F.col(month).between(month_of(lower), month_of(F.date_sub(upper, 1))))
    return out


class Lake:
    """All tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)
        self._tables: dict[str, ChangeTable] = {}

    def table(self, name: str) -> ChangeTable:
        return self._tables.setdefault(name, ChangeTable(self.spark, self.root, name))

    def names(self, namespace: str | None = None) -> list[str]:
        spaces = [namespace] if namespace else self.files.names(self.root)
        return [f"{ns}.{t}" for ns in spaces for t in self.files.names(f"{self.root}/{ns}")
                if self.files.exists(f"{self.root}/{ns}/{t}/commits")]

    def tables(self, namespace: str | None = None) -> DataFrame:
        """List of tables as a DataFrame."""
        rows = [tuple(n.split(".", 1)) for n in self.names(namespace)]
        return self.spark.createDataFrame(rows, "namespace string, table_name string")
