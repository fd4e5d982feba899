import json

from pyspark.sql import functions as F

from changelake import Lake
from changelake.operators import quality
from changelake.plans import layout, suite
from changelake.sources import files, tables
from tests.conftest import SF
from tests.test_lake import SCHEMA, changes


def test_full_maintenance_keeps_the_data(spark, folder):
    src = tables.parquet_tables(spark, SF)
    lake = Lake(spark, folder)
    for name, pk in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        lake.table(f"shop.{name}").bootstrap(src(name), [pk])
    orders = lake.table("shop.orders")
    orders.erase(F.col("o_custkey") == 44)
    orders.erase(F.col("o_custkey") == 45)
    frames = lambda: {n: lake.table(f"shop.{n}").current() for n in ("orders", "customer")}
    before = {n: quality.checksum(df.drop("_ingested_at")).first() for n, df in frames().items()}
    report = layout.maintain(spark, folder, layout=True, compaction=True, merge=True, expiry=True, orphans=True,
                             expire_minutes=0, retain_last=1, report_path=f"{folder}/reports/run.json")
    assert {n: quality.checksum(df.drop("_ingested_at")).first() for n, df in frames().items()} == before
    entry = report["tables"]["shop.orders"]
    assert list(entry["steps"]) == ["layout", "compact", "merge_changes", "expire", "orphans"]
    assert entry["after"]["delete_files"] == 0 and entry["after"]["snapshots"] == 1
    assert entry["steps"]["compact"]["strategy"] == "sort"
    health = {(r.table_name, r.statistic): (r.before, r.after) for r in layout.health_report(spark, report).collect()}
    assert health[("shop.orders", "snapshots")][1] == 1
    timings = tables.maintenance_reports(spark, f"{folder}/reports")
    assert timings.where("table_name = 'shop.orders' AND seconds >= 0").count() == 5
    assert json.loads(lake.files.read_text(f"{folder}/reports/run.json"))["tables"]
    # a second run has nothing left to do
    again = layout.maintain(spark, folder, ["shop.orders", "shop.missing"], compaction=True, expiry=True)
    assert list(again["tables"]) == ["shop.orders"]
    assert again["tables"]["shop.orders"]["steps"]["compact"]["rewritten"] is False
    try:
        layout.maintain(spark, folder, ["bad name"])
        raise AssertionError("accepted a bad name")
    except ValueError:
        pass
    lake_q = suite.LakeSource(lake)
    assert suite.q02(lake_q, "1995-03-01", "1995-03-31").first().orders <= 21
    plan = suite.q03(lake_q, "1995-01-01", "1996-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_month" in plan


def test_orphans_respect_references_and_age(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    table.append(changes(spark, [(1, "a", "2020-01-01", "c", 1, 1)]), SCHEMA, ["k"])
    layout.apply_layout(table, "day", "month", ["day"])
    layout.compact(table, rewrite_all=True)
    stray = changes(spark, [(9, "ghost", "2020-01-01", "c", 9, 9)]).withColumn("_version", F.lit(9).cast("long"))
    table.write_folder(stray.select(*table._file_schema(table.head()).names), "changes", 9, ["k"])
    assert layout.remove_orphans(table, older_than_minutes=0)["unreferenced"] == 0  # the 24 h floor
    listed = files.listing(spark, table.path).where(F.col("file_path").contains("version=9"))
    future = F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    named = spark.createDataFrame([], "file_path string")
    assert layout.orphan_files(listed, named, future).count() == listed.count() > 0


def test_expire_keeps_what_kept_versions_need(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    for i in range(5):
        table.append(changes(spark, [(i, f"v{i}", "2020-01-01", "c", i, i)]), SCHEMA, ["k"])
    layout.merge_changes(table)
    table.append(changes(spark, [(9, "v9", "2020-01-01", "c", 9, 9)]), SCHEMA, ["k"])
    out = layout.expire(table, older_than_minutes=0, retain_last=2)
    assert out["expired_versions"] == 5 and out["removed_folders"] == 5
    assert table.versions() == [5, 6]
    assert table.as_of(5).count() == 5 and table.current().count() == 6
    assert layout.expire(table, older_than_minutes=60, retain_last=1)["expired_versions"] == 0  # still young


def test_stats_of_live_files(spark, folder):
    lake = Lake(spark, folder)
    table = lake.table("shop.t")
    table.append(changes(spark, [(i, "a", f"2020-0{1 + i % 3}-01", "c", i, i) for i in range(30)]), SCHEMA, ["k"])
    layout.apply_layout(table, "day", "month")
    layout.compact(table, rewrite_all=True)
    table.append(changes(spark, [(1, "b", "2020-01-01", "u", 99, 99)]), SCHEMA, ["k"])
    got = {r.content: (r.files, r.records) for r in suite.n3(table).collect()}
    assert got[0][1] == 30 and got[1][1] == 1
    assert suite.n2(table).count() == 4
    props = {r.key: r.value for r in table.properties().collect()}
    assert props == {"primary-key": "k", "schema-id": "0", "month-column": "month"}
    kinds = {(r.table_name, r.kind) for r in layout.storage(lake, "shop").collect()}
    assert kinds == {("t", "data"), ("t", "metadata")}
    assert files.file_metadata(table.base(table.head())).agg(F.sum("record_count")).first()[0] == 30
    assert suite.n8(table, F.current_timestamp() + F.expr("INTERVAL 2 HOURS")).first()[0] == 30
    assert suite.n9(lake).collect()[0].table_name == "t"


def test_exports(spark, folder):
    df = spark.sql("SELECT 1 AS a, 'x,\"y\"' AS s, cast(null as string) AS n UNION ALL SELECT 2, 'plain', ''")
    suite.write_csv(df.coalesce(1), f"{folder}/csv")
    lines = sorted(r.value for r in spark.read.text(f"{folder}/csv").collect())
    assert lines == ['1,"x,""y""",', "2,plain,", "a,s,n"]
    back = tables.csv_sample(spark, f"{folder}/csv", "a int, s string, n string").orderBy("a").collect()
    assert back[0].s == 'x,"y"' and back[0].n is None
    suite.write_json(df, f"{folder}/json")
    assert spark.read.json(f"{folder}/json").count() == 2
    rows, more = suite.bounded(spark.range(10), 4)
    assert len(rows) == 4 and more and not suite.bounded(spark.range(3), 4)[1]


def test_load_guard(spark):
    assert tables.load_state(spark.range(0), spark.range(5)) == "load"
    assert tables.load_state(spark.range(5), spark.range(5)) == "skip"
    try:
        tables.load_state(spark.range(3), spark.range(5))
        raise AssertionError("accepted a partial load")
    except ValueError as exc:
        assert "3 of 5" in str(exc)


def late_change(spark, key, value, lsn, op="u"):
    return spark.createDataFrame([(key, value)], "k long, v string").withColumns({
        "_cdc_op": F.lit(op), "_cdc_source_ts": F.current_timestamp(), "_cdc_lsn": F.lit(lsn).cast("long"),
        "_ingested_at": F.current_timestamp(), "_offset": F.lit(lsn).cast("long")})


def test_deletes_hold_after_compaction(spark, folder):
    """A delete at 50, compaction, an update at 20: the row stays gone, in the state, in history and in
    differences, also after further compactions and merges; a new insert at 60 brings it back."""
    table = Lake(spark, folder).table("shop.t")
    table.bootstrap(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string"), ["k"], lsn=10)
    add = lambda *a, **kw: table.append(late_change(spark, *a, **kw), table.head().schema, ["k"])
    live = lambda: {r.k: r.v for r in table.current().collect()}
    add(1, None, 50, op="d")
    layout.compact(table, delete_threshold=1)
    assert table.head().tombstone_rows == 1 and not table.head().change_paths
    before = table.head().version
    add(1, "late", 20)
    add(2, "new", 55)
    assert live() == {2: "new", 3: "c"}
    assert {(r.k, r.change) for r in table.diff(before, table.head().version).collect()} == {(2, "updated")}
    assert all(r.row is None for r in table.row_history([1], depth=3).collect())
    layout.merge_changes(table)
    assert live() == {2: "new", 3: "c"}
    layout.compact(table, rewrite_all=True)
    add(1, "late again", 30)
    assert live() == {2: "new", 3: "c"} and table.head().tombstone_rows == 1
    add(1, "back", 60, op="c")
    assert live() == {1: "back", 2: "new", 3: "c"}
    layout.compact(table, delete_threshold=1)
    assert live() == {1: "back", 2: "new", 3: "c"} and table.head().tombstone_rows == 0
    add(1, "older", 40)
    assert live()[1] == "back"


def test_tombstones_end_at_the_floor(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    table.bootstrap(spark.createDataFrame([(i, "a") for i in range(6)], "k long, v string"), ["k"], lsn=10)
    for key, lsn in ((0, 50), (1, 60), (2, 70)):
        table.append(late_change(spark, key, None, lsn, op="d"), table.head().schema, ["k"])
    layout.compact(table, delete_threshold=1)
    assert table.head().tombstone_rows == 3
    assert layout.trim_tombstones(table, 60) == {"tombstones_before": 3, "tombstones_after": 2}
    assert layout.trim_tombstones(table, 60)["tombstones_after"] == 2
    table.append(late_change(spark, 3, None, 80, op="d"), table.head().schema, ["k"])
    layout.compact(table, delete_threshold=1, tombstones_from_lsn=70)
    assert table.head().tombstone_rows == 2 and {r.k for r in table.current().collect()} == {4, 5}
    # the folders of older tombstones go with the versions that name them
    layout.expire(table, older_than_minutes=0, retain_last=1)
    assert layout.drop_unnamed(table) == 0
    kept = table.files.names(f"{table.path}/tombstones")
    assert [f"tombstones/{n}" for n in kept] == table.head().tombstone_paths


def test_purge_leaves_no_key_and_no_way_back(spark, folder):
    table = Lake(spark, folder).table("shop.t")
    table.bootstrap(spark.createDataFrame([(i, f"person {i}") for i in range(6)], "k long, v string"), ["k"], lsn=10)
    table.erase(F.col("k") == 4)
    layout.purge(table)
    assert layout.residue(table, "k", [4]).count() == 0
    dead = table.tombstones(table.head())
    assert dead.columns == ["_key", "_cdc_lsn", "_offset", "_version"] and dead.count() == 1
    table.append(late_change(spark, 4, "person 4", 5), table.head().schema, ["k"])
    assert {r.k for r in table.current().collect()} == {0, 1, 2, 3, 5}
    layout.purge(table)
    assert layout.residue(table, "k", [4]).count() == 0


def by_month(spark, folder, months=6):
    table = Lake(spark, folder).table("shop.t")
    rows = spark.range(months * 20).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.make_date(
        F.lit(2024), (F.col("id") % months + 1).cast("int"), F.lit(5)).cast("timestamp_ntz").alias("at"))
    table.bootstrap(rows, ["k"], lsn=10)
    layout.apply_layout(table, month_source="at", month_column="m", sort_by=["at"])
    layout.compact(table, rewrite_all=True)
    return table


def month_changes(spark, rows, lsn):
    return spark.createDataFrame([(k, v, op, lsn, lsn * 1000 + k) for k, v, op in rows], "k long, v string, _cdc_op string, _cdc_lsn long, _offset long").select(
        "k", "v", F.make_date(F.lit(2024), (F.col("k") % 6 + 1).cast("int"), F.lit(5)).cast("timestamp_ntz").alias("at"), "_cdc_op",
        F.current_timestamp().alias("_cdc_source_ts"), "_cdc_lsn", F.current_timestamp().alias("_ingested_at"), "_offset")


def test_packing():
    assert layout.packed({"a": 5, "b": 5, "c": 20, "d": 1, "e": 1}, 10) == [["a", "b"], ["c"], ["d", "e"]]
    assert layout.packed({}, 10) == []


def test_compaction_goes_on_where_it_was_killed(spark, folder, monkeypatch):
    table = by_month(spark, folder)
    want = {k: "a" for k in range(120)}
    first = [(k, "b", "u") for k in range(0, 120, 5)] + [(k, None, "d") for k in range(1, 120, 10)] + [(500 + k, "new", "c") for k in range(6)]
    table.append(month_changes(spark, first, 20), table.head().schema, ["k"])
    for k, v, op in first:
        want.pop(k, None) if op == "d" else want.__setitem__(k, v)
    state = lambda: {r.k: r.v for r in table.current().collect()}
    assert state() == want
    done, real = [], layout.rewrite_months

    def killed(*args):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(args[1])
        return real(*args)
    monkeypatch.setattr(layout, "rewrite_months", killed)
    try:
        layout.compact_in_groups(table, group_bytes=1)
    except KeyboardInterrupt:
        pass
    assert len(done) == 2 and state() == want and table.head().change_paths
    later = [(2, "late", "u"), (3, None, "d"), (700, "x", "c")]
    table.append(month_changes(spark, later, 30), table.head().schema, ["k"])
    for k, v, op in later:
        want.pop(k, None) if op == "d" else want.__setitem__(k, v)
    assert state() == want
    again = []
    monkeypatch.setattr(layout, "rewrite_months", lambda *a: again.append(a[1]) or real(*a))
    report = layout.compact_in_groups(table, group_bytes=1)
    assert report["continued"] and not {m for g in done for m in g} & {m for g in again for m in g}
    assert report["months"] == len({m for g in done + again for m in g}) == 6
    head = table.head()
    assert state() == want and len(head.change_paths) == 1 and "compaction" not in head.properties
    assert head.tombstone_rows == 12 and head.base_rows == table.base(head).count()
    assert layout.compact_in_groups(table)["groups"] == 1 and state() == want and not table.head().change_paths
    assert layout.compact_in_groups(table) == {"groups": 0, "rewritten": False}
    layout.expire(table, older_than_minutes=0, retain_last=1)
    assert state() == want


def test_binpack_does_not_narrow_the_work_before_it(spark):
    rows = spark.range(1000).groupBy(F.pmod("id", F.lit(100)).alias("k")).count()
    made = layout.arrange(rows, 2 * layout.TARGET_FILE_BYTES, {}, layout.TARGET_FILE_BYTES)
    assert "Coalesce " not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 100 and made.rdd.getNumPartitions() == 2


def test_groups_in_order_read_only_their_own_months(spark, folder, monkeypatch):
    table = by_month(spark, folder)
    moved = [(k, "b", "u") for k in range(0, 120, 5)] + [(1, None, "d"), (501, "new", "c")]
    table.append(month_changes(spark, moved, 20), table.head().schema, ["k"])
    want, real, whole = {r.k: r.v for r in table.current().collect()}, table.state, []
    monkeypatch.setattr(table, "state", lambda commit: whole.append(1) or real(commit))
    assert layout.compact_in_groups(table, group_bytes=1)["groups"] == 6 and not whole
    assert {r.k: r.v for r in table.current().collect()} == want
