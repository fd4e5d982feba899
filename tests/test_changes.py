import random

import pytest
from pyspark.sql import functions as F

from changelake.operators import changes as c
from changelake.operators import versions as v

DDL = "k long, a string, _cdc_op string, _cdc_lsn long, _offset long, _version long"


def random_log(seed, n=300, keys=25, versions=6):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        key = 7 if rnd.random() < 0.35 else rnd.randrange(keys)  # one hot key
        op = rnd.choice("cuuud")
        rows.append((key, f"v{i}", op, i // 2, i, i * versions // n))
    return rows


def oracle(rows, upto=None):
    best = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[5])):
        if upto is None or r[5] <= upto:
            best[r[0]] = r
    return {k: r for k, r in best.items() if r[2] != "d"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_window_and_merge_agree(spark, seed):
    rows = random_log(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, DDL)
    want = sorted(tuple(r) for r in oracle(rows).values())
    assert sorted(tuple(r) for r in c.fold([df], ["k"]).collect()) == want
    assert sorted(tuple(r) for r in c.alive(c.latest_per_key_window(df, ["k"])).collect()) == want
    merged = df.where("_version < 0")
    for step in range(6):  # merge batch by batch
        merged = c.apply_changes(merged, c.latest_per_key(df.where(F.col("_version") == step), ["k"]), ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == want


def test_merge_rules(spark):
    target = spark.createDataFrame([(1, "a", "r"), (2, "b", "r"), (3, "c", "r")], "k long, a string, _cdc_op string")
    change = spark.createDataFrame([(1, "A", "u"), (2, None, "d"), (9, None, "d"), (4, "new", "u")],
                                   "k long, a string, _cdc_op string")
    out = {r.k: (r.a, r._cdc_op) for r in c.apply_changes(target, change, ["k"]).collect()}
    assert out == {1: ("A", "u"), 3: ("c", "r"), 4: ("new", "u")}  # unknown deletes do nothing


def test_late_events_do_not_win(spark):
    df = spark.createDataFrame([(1, "new", "u", 50, 9, 0), (1, "late", "u", 40, 3, 5)], DDL)
    assert c.fold([df], ["k"]).first().a == "new"


def test_op_counts(spark):
    df = spark.createDataFrame([(1, "c"), (1, "r"), (1, "u"), (2, "d")], "b int, _cdc_op string")
    got = {r.b: (r.rows, r.inserts, r.updates, r.deletes) for r in c.op_counts(df, ["b"]).collect()}
    assert got == {1: (3, 2, 1, 0), 2: (1, 0, 0, 1)}


@pytest.mark.parametrize("seed", [4, 5])
def test_history_and_diff_against_brute_force(spark, seed):
    rows = random_log(seed)
    df = spark.createDataFrame(rows, DDL)
    listed = [1, 3, 5]
    got = {(r.k, r.version): (r.row.a if r.row else None) for r in v.row_history(df, ["k"], listed).collect()}
    for (k, version), a in got.items():
        row = oracle(rows, version).get(k)
        assert a == (row[1] if row else None), (k, version)
    assert {k for k, _ in got} == {r[0] for r in rows}
    old, new = oracle(rows, 1), oracle(rows, 4)
    want = {k: "inserted" if k not in old else "deleted" if k not in new else "updated"
            for k in old.keys() | new.keys() if old.get(k, [0, 0])[1] != new.get(k, [0, 0])[1]}
    assert {r.k: r.change for r in v.diff(df, ["k"], 1, 4).collect()} == want


def test_history_changes(spark):
    rows = [(1, "x", "c", 0, 0, 0), (1, "x", "u", 1, 1, 1), (1, "y", "u", 2, 2, 2), (1, None, "d", 3, 3, 3)]
    hist = v.row_history(spark.createDataFrame(rows, DDL), ["k"], [0, 1, 2, 3])
    got = {r.version: (r.changed_columns, r.is_change) for r in v.history_changes(hist, ["k"]).collect()}
    assert got == {0: ([], False), 1: ([], False), 2: (["a"], True), 3: ([], True)}


def test_row_compare_decimals_by_value(spark):
    src = spark.sql("SELECT 1L AS k, cast(777.7 as decimal(12,2)) AS p, cast(null as string) AS n")
    lake = spark.sql("SELECT 1L AS k, cast(777.7 as decimal(12,1)) AS p, 'x' AS n, 'u' AS _cdc_op")
    got = {r.column: (r.equal, r.is_meta) for r in v.row_compare(src, lake, ["k"]).collect()}
    assert got == {"k": (True, False), "p": (True, False), "n": (False, False), "_cdc_op": (None, True)}
    keys = spark.createDataFrame([(1,), (5,)], "k long")
    here = {r.k: (r.in_source, r.in_lake) for r in v.presence(src, lake, keys, ["k"]).collect()}
    assert here == {1: (True, True), 5: (False, False)}


def test_intervals(spark):
    """A late change opens no interval, a delete opens an empty one, unlisted versions count for the next one."""
    rows = [(1, "10", "c", 1, 0, 0), (1, "11", "u", 5, 0, 1), (1, "99", "u", 3, 0, 2), (1, None, "d", 9, 0, 4), (2, "7", "c", 8, 0, 3)]
    found = v.intervals(spark.createDataFrame(rows, DDL), ["k"], [0, 1, 2, 4, 6]).collect()
    got = sorted((r.k, r.valid_from, r.valid_to, r.row.a if r.row else None, r.first) for r in found)
    assert got == [(1, 0, 1, "10", True), (1, 1, 4, "11", False), (1, 4, None, None, False), (2, 4, None, "7", True)]
    history = v.row_history(spark.createDataFrame(rows, DDL), ["k"], [0, 1, 2, 4, 6]).collect()
    assert len(history) == 10 and {r.version for r in history if r.k == 2 and r.row} == {4, 6}
