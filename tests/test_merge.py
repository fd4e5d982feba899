import random
import uuid

from pyspark.sql import functions as F

from changelake.operators.changes import fold
from changelake.operators.merge import SLICE, MergeTarget

DDL = "k long, `a b` string, _cdc_op string, _cdc_lsn long, _offset long, _version long"


def target(spark, folder, rows, **layout):
    made = MergeTarget(spark, f"merge_{uuid.uuid4().hex[:8]}", folder, ["k"], **layout)
    made.create(spark.createDataFrame(rows, DDL))
    return made


def test_merge_equals_the_fold(spark, folder):
    rnd = random.Random(3)
    base = [(k, f"v{k}", "r", 0, 0, 0) for k in range(200)]
    table, log = target(spark, folder, base, slices=8, buckets=4), list(base)
    for version in range(1, 5):
        batch = [(rnd.randrange(260), rnd.choice(["x", None, "y"]), rnd.choice("cuud"), rnd.randrange(1, 500), n, version)
                 for n in range(40)]
        table.merge(spark.createDataFrame(batch, DDL))
        if version == 2:                                 # a batch that is repeated changes nothing
            table.merge(spark.createDataFrame(batch, DDL))
        log += batch
    # a target keeps no tombstones: positions only compare with rows that are there
    state = {}
    for version in range(5):
        newest = {}
        for r in (r for r in log if r[5] == version):
            if r[0] not in newest or r[3:] > newest[r[0]][3:]:
                newest[r[0]] = r
        for k, r in newest.items():
            if k in state and r[3:] < state[k][3:]:
                continue
            state.pop(k, None)
            if r[2] != "d":
                state[k] = r
    assert sorted(tuple(r) for r in table.rows().collect()) == sorted(state.values(), key=lambda r: r[0])


def test_in_order_merges_equal_one_fold(spark, folder):
    base = [(k, "v", "r", 0, 0, 0) for k in range(100)]
    steps = [[(k, f"s{n}", "d" if k % 7 == n else "u", n, k, n) for k in range(n, 130, 3)] for n in (1, 2, 3)]
    table = target(spark, folder, base, slices=5, buckets=3)
    for s in steps:
        table.merge(spark.createDataFrame(s, DDL))
    want = fold([spark.createDataFrame([*base, *sum(steps, [])], DDL)], ["k"])
    assert sorted(table.rows().collect()) == sorted(want.select(*table.rows().columns).collect())


def test_target_is_not_shuffled(spark, folder):
    table = target(spark, folder, [(k, "v", "r", 0, 0, 0) for k in range(500)], slices=6, buckets=4)
    changes = spark.createDataFrame([(1, "w", "u", 5, 5, 1), (900, "n", "c", 5, 6, 1)], DDL)
    plan = table.merged(changes, [0, 1])._jdf.queryExecution().executedPlan().toString()
    # what stands below the target's side of the join: a pruned scan of its buckets and no exchange
    scan = plan.index("FileScan parquet")
    side = plan[plan.index("SortMergeJoin"):scan].rsplit("\n:- ", 1)[-1]
    assert "Exchange" not in side and "Bucketed: true" in plan[scan:scan + 800], plan
    assert f"PartitionFilters: [isnotnull({SLICE}" in plan or f"PartitionFilters: [{SLICE}" in plan, plan
    assert plan.count("Exchange hashpartitioning(k") == 1, plan


def test_only_touched_slices_are_written(spark, folder):
    table = target(spark, folder, [(k, "v", "r", 0, 0, 0) for k in range(300)], slices=10, buckets=2)
    files = lambda: {r[0] for r in spark.table(table.name).select(F.input_file_name()).distinct().collect()}
    before = files()
    assert table.merge(spark.createDataFrame([(7, "w", "u", 5, 5, 1)], DDL)) == {"slices": 1}
    after = files()
    assert len(before - after) <= 2 and len(before & after) >= len(before) - 2
    assert table.merge(spark.createDataFrame([], DDL)) == {"slices": 0}
    lonely = spark.table(table.name).where(f"{SLICE} = 3").select("k").collect()
    table.merge(spark.createDataFrame([(r.k, None, "d", 9, 9, 2) for r in lonely], DDL))
    assert spark.table(table.name).where(f"{SLICE} = 3").count() == 0 and table.rows().count() == 300 - len(lonely)
    table.merge(spark.createDataFrame([(r.k, "again", "c", 10, 9, 3) for r in lonely[:1]], DDL))
    assert spark.table(table.name).where(f"{SLICE} = 3").count() == 1
