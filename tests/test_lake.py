import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake import Lake, VersionExpired
from changelake.lake import CommitConflict
from changelake.operators import quality
from changelake.operators.changes import fold, latest_per_key
from changelake.plans import layout

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.StringType()),
                       T.StructField("day", T.DateType())])
DDL = "k long, a string, day string, _cdc_op string, _cdc_lsn long, _offset long"


def changes(spark, rows):
    return (spark.createDataFrame(rows, DDL).withColumn("day", F.col("day").cast("date"))
            .withColumn("_cdc_source_ts", F.current_timestamp()).withColumn("_ingested_at", F.current_timestamp()))


def random_batches(seed, n_batches=5, n=60, keys=15, late=False):
    rnd, out, i = random.Random(seed), [], 0
    for _ in range(n_batches):
        rows = []
        for _ in range(n):
            lsn = i if not late else rnd.randrange(i + 1)
            rows.append((rnd.randrange(keys), f"v{i}", f"20{rnd.randrange(10, 14)}-0{rnd.randrange(1, 5)}-11",
                         rnd.choice("cuuud"), lsn, i))
            i += 1
        out.append(rows)
    return out


def expected(batches):
    best = {}
    for r in sorted((r for b in batches for r in b), key=lambda r: (r[4], r[5])):
        best[r[0]] = r
    return sorted((r[0], r[1], r[2]) for r in best.values() if r[3] != "d")


def visible(df):
    return sorted((r.k, r.a, str(r.day)) for r in df.collect())


@pytest.mark.parametrize("late", [False, True])
def test_commits_compaction_and_time_travel(spark, folder, late):
    batches = random_batches(11 + late, late=late)
    table = Lake(spark, folder).table("shop.t")
    for rows in batches[:3]:
        table.append(latest_per_key(changes(spark, rows), ["k"]), SCHEMA, ["k"])
    assert visible(table.current()) == expected(batches[:3])
    layout.apply_layout(table, "day", "month", ["day", "k"])
    assert layout.apply_layout(table, "day", "month", ["day", "k"])["applied"] == []  # idempotent
    keep_all = 0 if late else None  # late events need the tombstones of compacted deletes
    layout.compact(table, rewrite_all=True, tombstones_from_lsn=keep_all)
    assert visible(table.current()) == expected(batches[:3])
    for n, rows in enumerate(batches[3:], 4):
        table.append(latest_per_key(changes(spark, rows), ["k"]), SCHEMA, ["k"])
        assert visible(table.current()) == expected(batches[:n])
    assert table.head().in_order is not late
    before = quality.checksum(table.current()).first()
    layout.merge_changes(table)
    assert quality.checksum(table.current()).first() == before
    layout.compact(table, tombstones_from_lsn=keep_all)  # touched months only
    assert quality.checksum(table.current()).first() == before
    for n in (1, 2, 3):  # every version stays readable
        assert visible(table.as_of(n - 1)) == expected(batches[:n])
    assert visible(table.scan_range("day", "2011-02-01", "2012-03-01")) == [
        r for r in expected(batches) if "2011-02-01" <= r[2] < "2012-03-01"]


def test_incremental_compaction_keeps_untouched_months(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    base = changes(spark, [(i, "x", f"2020-{1 + i % 6:02d}-01", "c", i, i) for i in range(60)])
    table.append(base, SCHEMA, ["k"])
    layout.apply_layout(table, "day", "month", ["day"])
    layout.compact(table, rewrite_all=True)
    first = set(table.head().base_paths)
    # one row moves from month 1 to month 2, one row of month 3 is deleted
    table.append(changes(spark, [(0, "moved", "2020-02-15", "u", 100, 100), (2, None, None, "d", 101, 101)]),
                 SCHEMA, ["k"])
    layout.compact(table, delete_threshold=1)
    kept = {p.split("=")[-1] for p in first & set(table.head().base_paths)}
    assert kept == {"2020-04", "2020-05", "2020-06"}
    rows = {r.k: (r.a, str(r.day)) for r in table.current().collect()}
    assert rows[0] == ("moved", "2020-02-15") and 2 not in rows and len(rows) == 59
    assert table.head().base_rows == 59


def test_replays_conflicts_and_streams(spark, folder):
    table, other = Lake(spark, folder).table("shop.t"), Lake(spark, folder).table("shop.t")
    table.append(changes(spark, [(1, "a", None, "c", 1, 1)]), SCHEMA, ["k"], "s1", 0)
    assert table.applied("s1", 0) and not table.applied("s1", 1) and not table.applied("s2", 0)
    assert other.head().version == 0
    table.append(changes(spark, [(2, "b", None, "c", 2, 2)]), SCHEMA, ["k"], "s1", 1)
    assert other.head().version == 1  # a stale head is noticed
    other.append(changes(spark, [(3, "c", None, "c", 3, 3)]), SCHEMA, ["k"], "s2", 0)
    assert table.applied("s1", 1) and table.applied("s2", 0)
    with pytest.raises(CommitConflict):
        table.publish(table.commit_at(1))
    assert len(visible(table.current())) == 3


def test_unpublished_writes_are_invisible(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    table.append(changes(spark, [(1, "a", None, "c", 1, 1)]), SCHEMA, ["k"])
    rows = changes(spark, [(9, "ghost", None, "c", 9, 9)]).withColumn("_version", F.lit(1).cast("long"))
    table.write_folder(rows.select(*table._file_schema(table.head()).names), "changes", 1, ["k"])  # then a crash
    assert visible(table.current()) == [(1, "a", "None")]
    table.append(changes(spark, [(2, "b", None, "c", 2, 2)]), SCHEMA, ["k"])
    assert [r[0] for r in visible(table.current())] == [1, 2]


def test_schema_evolution_across_files(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    narrow = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.IntegerType()),
                           T.StructField("p", T.DecimalType(10, 2))])
    wide = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()),
                         T.StructField("p", T.DecimalType(12, 2)), T.StructField("note", T.StringType())])
    meta = "'c' AS _cdc_op, current_timestamp() AS _cdc_source_ts, current_timestamp() AS _ingested_at, "
    table.append(spark.sql(f"SELECT 1L AS k, 5 AS n, cast(1.25 as decimal(10,2)) AS p, {meta} 1L AS _cdc_lsn, 1L AS _offset"),
                 narrow, ["k"])
    layout.compact(table, rewrite_all=True)
    step = table.evolved(wide, ["k"])
    assert len(step.changes) == 3
    table.append(spark.sql(f"SELECT 2L AS k, 3000000000L AS n, cast(9999999999.5 as decimal(12,2)) AS p, 'x' AS note, "
                           f"{meta} 2L AS _cdc_lsn, 2L AS _offset"), step.schema, ["k"])
    rows = {r.k: (r.n, str(r.p), r.note) for r in table.current().collect()}
    assert rows == {1: (5, "1.25", None), 2: (3000000000, "9999999999.50", "x")}
    assert [r.schema_id for r in table.schema_log().collect()] == [1, 0]
    assert table.as_of(0).columns[:3] == ["k", "n", "p"]


def test_bootstrap_history_erase_purge(spark, folder):
    lake = Lake(spark, folder)
    table = lake.table("shop.t")
    table.bootstrap(spark.range(20).select(F.col("id").alias("k"), (F.col("id") % 4).alias("owner")), ["k"])
    assert table.current().where("_cdc_op = 'r'").count() == 20
    table.erase(F.col("owner") == 3)
    assert table.current().where("owner = 3").count() == 0 and table.head().in_order
    assert table.as_of(0).where("owner = 3").count() == 5  # still readable in the past
    stats = table.version_stats(0).first()
    assert (stats.rows_then, stats.rows_now) == (20, 15)
    hist = {(r.k, r.version): r.row is not None for r in table.row_history([3, 4]).collect()}
    assert hist == {(3, 0): True, (3, 1): False, (4, 0): True, (4, 1): True}
    assert {r.change for r in table.diff(0, 1).collect()} == {"deleted"} and table.diff(0, 1).count() == 5
    assert layout.residue(table, "k", [3, 7]).count() > 0
    layout.purge(table)
    assert layout.residue(table, "k", [3, 7]).count() == 0
    with pytest.raises(VersionExpired):
        table.as_of(0)
    assert table.current().count() == 15
    assert [r.table_name for r in lake.tables("shop").collect()] == ["t"]
    table.bootstrap(spark.range(3).select(F.col("id").alias("k")), ["k"])  # rebuild
    assert table.current().count() == 3 and table.head().operation == "overwrite"


def test_as_of_timestamp(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    first = table.bootstrap(spark.range(5).select(F.col("id").alias("k")), ["k"])
    table.erase(F.col("k") < 2)
    assert table.as_of(timestamp=first.committed_at).count() == 5
    with pytest.raises(VersionExpired):
        table.as_of(timestamp="2001-01-01 00:00:00")
    snaps = table.snapshots().collect()
    assert [(s.operation, s.rows_deleted) for s in snaps] == [("append", "2"), ("overwrite", "0")]


def test_tombstones_stop_late_events(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    table.append(changes(spark, [(1, "a", None, "c", 1, 1), (2, "b", None, "c", 2, 2)]), SCHEMA, ["k"])
    table.append(changes(spark, [(1, None, None, "d", 10, 10)]), SCHEMA, ["k"])
    layout.compact(table, delete_threshold=1, tombstones_from_lsn=5)
    assert visible(table.current()) == [(2, "b", "None")]
    table.append(changes(spark, [(1, "late", None, "u", 3, 3)]), SCHEMA, ["k"])
    assert visible(table.current()) == [(2, "b", "None")]


def test_plan_of_a_month_scan(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    rows = [(i, "x", f"2020-{1 + i % 12:02d}-01", "c", i, i) for i in range(240)]
    table.append(changes(spark, rows), SCHEMA, ["k"])
    layout.apply_layout(table, "day", "month", ["day"])
    layout.compact(table, rewrite_all=True)
    table.append(changes(spark, [(3, "y", "2020-04-02", "u", 999, 999)]), SCHEMA, ["k"])
    df = table.scan_range("day", "2020-04-01", "2020-05-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(day" in plan
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan  # the base is not shuffled
    assert df.count() == 20
    assert fold([table.changes(table.head())], ["k"]).count() == 1


def test_a_cached_head_notices_expiry_elsewhere(spark, folder):
    reader, writer = Lake(spark, folder).table("shop.t"), Lake(spark, folder).table("shop.t")
    writer.append(changes(spark, [(1, "a", "2020-01-01", "c", 1, 1)]), SCHEMA, ["k"])
    assert reader.current().count() == 1  # caches version 0
    writer.append(changes(spark, [(2, "b", "2020-01-01", "c", 2, 2)]), SCHEMA, ["k"])
    layout.maintain(spark, folder, ["shop.t"], compaction=True)
    layout.expire(writer, older_than_minutes=0, retain_last=1)
    assert writer.versions() == [2] and reader.head().version == 2
    assert reader.current().count() == 2


def test_interleaved_writers_lose_nothing(spark, folder):
    a, b = Lake(spark, folder).table("shop.t"), Lake(spark, folder).table("shop.t")
    a.append(changes(spark, [(1, "a", None, "c", 1, 1)]), SCHEMA, ["k"], "s1", 0)
    b.append(changes(spark, [(2, "b", None, "c", 2, 2)]), SCHEMA, ["k"], "s2", 0)
    a.append(changes(spark, [(3, "c", None, "c", 3, 3)]), SCHEMA, ["k"], "s1", 1)
    b.append(changes(spark, [(4, "d", None, "c", 4, 4)]), SCHEMA, ["k"], "s2", 1)
    assert [v[0] for v in visible(b.current())] == [1, 2, 3, 4]
    # two commits of one version: the second fails and leaves the first one's rows alone
    made = changes(spark, [(9, "x", None, "c", 9, 9)])
    b.next_version = lambda: a.head().version
    with pytest.raises(CommitConflict):
        b.append(made, SCHEMA, ["k"], "s2", 2)
    assert [v[0] for v in visible(a.current())] == [1, 2, 3, 4]


def test_history_and_diff_over_a_rebuild(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    table.append(changes(spark, [(1, "a", None, "c", 1, 1), (2, "b", None, "c", 2, 2)]), SCHEMA, ["k"])
    table.append(changes(spark, [(1, "x5", None, "u", 50, 50)]), SCHEMA, ["k"])
    table.bootstrap(spark.createDataFrame([(1, "new", None), (3, "c", None)], SCHEMA), ["k"])
    table.append(changes(spark, [(3, "c2", None, "u", 60, 60)]), SCHEMA, ["k"])
    assert {(r.k, r.change) for r in table.diff(1, 2).collect()} == {(1, "updated"), (2, "deleted"), (3, "inserted")}
    assert {(r.k, r.change) for r in table.diff(0, 3).collect()} == {(1, "updated"), (2, "deleted"), (3, "inserted")}
    name = SCHEMA.fields[1].name
    seen = {(r.k, r.version): r.row and r.row[name] for r in table.row_history([1, 2, 3]).collect()}
    assert {k: v for k, v in seen.items() if v} == {
        (1, 0): "a", (1, 1): "x5", (1, 2): "new", (1, 3): "new", (2, 0): "b", (2, 1): "b", (3, 2): "c", (3, 3): "c2"}


def test_history_of_a_composite_key(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    table.bootstrap(spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "a long, b long, v string"), ["a", "b"])
    assert [(r.a, r.b) for r in table.row_history([(1, 2)]).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        table.row_history([1])


def test_purge_takes_folders_of_crashed_writes(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    table.bootstrap(spark.range(8).select(F.col("id").alias("k"), (F.col("id") % 4).alias("owner")), ["k"])
    table.write_folder(table.state(table.head()), "base", 7, ["k"])      # no commit names it
    table.erase(F.col("owner") == 3)
    layout.purge(table)
    assert layout.residue(table, "k", [3, 7]).count() == 0 and table.current().count() == 6


def test_a_crash_within_a_commit_leaves_the_table_as_it_was(spark, folder, monkeypatch):
    table = Lake(spark, folder).table("shop.t")
    table.bootstrap(spark.createDataFrame([(1, "a")], "k long, v string"), ["k"], lsn=1)
    files = table.files
    assert files.write_new(f"{folder}/x/one.json", "1") and not files.write_new(f"{folder}/x/one.json", "2")
    assert files.read_text(f"{folder}/x/one.json") == "1" and files.names(f"{folder}/x") == ["one.json"]

    def crash(source, target):
        raise KeyboardInterrupt                          # the process ends between the text and its name
    monkeypatch.setattr(files, "_rename", crash)
    with pytest.raises(KeyboardInterrupt):
        table.erase(F.col("k") == 1)
    again = Lake(spark, folder).table("shop.t")
    assert again.versions() == [0] and again.current().count() == 1 and again.log().count() == 1
    again.erase(F.col("k") == 1)
    assert again.current().count() == 0
    # a second writer finds the name taken
    monkeypatch.undo()
    late = again.commit_at(1)
    with pytest.raises(CommitConflict):
        table.publish(late)
