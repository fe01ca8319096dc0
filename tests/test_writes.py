import os
import random

import pytest
from pyspark.sql import functions as F

from rollcall.errors import ConstraintViolation, NotFound, StoreError
from rollcall.operators import groups, reads, writes
from rollcall.schema import GUESTS

COLUMNS = "id string, name string, hash string"


def _id(n):
    return f"{n:08x}-0000-4000-8000-000000000000"


def _rows(spark, rows):
    return spark.createDataFrame([(i if i is None else _id(i), n, h, k) for k, (i, n, h) in enumerate(rows)], COLUMNS + ", ordinal long")


def _stored(spark, rows):
    return spark.createDataFrame([(_id(i), n, h) for i, n, h in rows], COLUMNS)


def _by_row(stored, batch):
    """The batch inserted a row at a time."""
    ids, names = {i for i, _, _ in stored}, {n for _, n, _ in stored}
    good, bad = [], {}
    for k, (i, n, h) in enumerate(batch):
        reason = "null" if None in (i, n, h) else "id" if i in ids else "name" if n in names else None
        if reason:
            bad[k] = reason
        else:
            ids.add(i)
            names.add(n)
            good.append(k)
    return good, bad


CASES = [
    ([(1, "x", "h")], [(1, "y", "h"), (2, "x", "h"), (3, "z", None), (4, "w", "h")]),
    ([], [(1, "x", "h"), (1, "y", "h"), (2, "y", "h")]),
    ([], [(1, "a", "h"), (1, "b", "h"), (2, "b", "h"), (2, "c", "h"), (3, "c", "h"), (3, "a", "h")]),
    ([(9, "q", "h")], []),
    ([], [(None, "a", "h"), (1, None, "h"), (1, "a", "h"), (1, "a", "h")]),
]


@pytest.fixture(params=[writes.IN_TURN, 0])
def in_turn(request, monkeypatch):
    """All contested rows on the driver, or all in groups."""
    monkeypatch.setattr(writes, "IN_TURN", request.param)


@pytest.mark.parametrize("stored,batch", CASES)
def test_insert_is_as_row_by_row(spark, in_turn, stored, batch):
    done = writes.insert(GUESTS, _stored(spark, stored), _rows(spark, batch))
    good, bad = _by_row(stored, batch)
    assert sorted(tuple(r) for r in done.accepted.collect()) == sorted((_id(batch[k][0]), batch[k][1], batch[k][2]) for k in good)
    assert {r["ordinal"]: r["reason"] for r in done.refused.collect()} == bad


def test_insert_of_a_random_batch(spark, in_turn):
    rng = random.Random(3)
    stored = [(k, f"n{k}", "h") for k in range(3)]
    batch = [(rng.randrange(14), f"n{rng.randrange(14)}", rng.choice(["h", "h", None])) for _ in range(40)]
    done = writes.insert(GUESTS, _stored(spark, stored), _rows(spark, batch))
    good, bad = _by_row(stored, batch)
    assert {r["ordinal"]: r["reason"] for r in done.refused.collect()} == bad
    assert done.accepted.count() == len(good)
    state = writes.insert_state(GUESTS, _stored(spark, stored), done)
    assert state.count() == len(stored) + len(good) and writes.violations(GUESTS, state).count() == 0


def _chain(spark, n):
    """Each row clashes with the one before, by id and by name in turn, so that every other one is accepted."""
    return _rows(spark, [((k + 1) // 2, f"n{k // 2}", "h") for k in range(n)])


def _jobs(spark, run):
    spark.sparkContext.setJobGroup(f"counted-{id(run)}", "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"counted-{id(run)}"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_a_long_chain_takes_no_more_jobs(spark):
    found, jobs = {}, {}
    for n in (8, 1000):
        rows = _chain(spark, n)

        def run(rows=rows, n=n):
            found[n] = sorted(r["id"] for r in writes.insert(GUESTS, _stored(spark, []), rows).accepted.collect())

        jobs[n] = _jobs(spark, run)
    assert jobs[1000] <= jobs[8] < 40
    assert len(found[8]) == 4 and found[1000] == [_id((k + 1) // 2) for k in range(0, 1000, 2)]


def test_a_long_chain_in_groups(spark, monkeypatch):
    monkeypatch.setattr(writes, "IN_TURN", 0)
    batch = [((k + 1) // 2, f"n{k // 2}", "h") for k in range(70)] + [(500 + k, "hot", "h") for k in range(200)] + [(900, "x", "h"), (900, "y", "h"), (901, "y", "h"), (901, "x", "h")]
    random.Random(1).shuffle(batch)
    done = writes.insert(GUESTS, _stored(spark, [(3, "old", "h")]), _rows(spark, batch))
    good, bad = _by_row([(3, "old", "h")], batch)
    assert {r["ordinal"]: r["reason"] for r in done.refused.collect()} == bad and done.accepted.count() == len(good)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = [p.rsplit("/", 1)[1] for p in done.paths]
    assert len(held) == 1
    done.release()
    assert not set(held) & set(os.listdir(shared))


def test_insert_sends_no_table_through_the_driver(spark, monkeypatch):
    """Nothing that grows with the table or the batch is broadcast, however small it is."""
    monkeypatch.setattr(writes, "IN_TURN", 0)
    plans = []
    for module in (writes, groups):

        def seen(df, paths=None, settled=module.settled):
            plans.append(df._jdf.queryExecution().toString())
            return settled(df, paths)

        monkeypatch.setattr(module, "settled", seen)
    batch = [((k + 1) // 2, f"n{k // 2}", "h") for k in range(10)] + [(3, "n0", "h"), (99, "old", "h")]
    stored = [(4, "old", "h")]
    done = writes.insert(GUESTS, _stored(spark, stored), _rows(spark, batch))
    good, bad = _by_row(stored, batch)
    assert {r["ordinal"]: r["reason"] for r in done.refused.collect()} == bad and done.accepted.count() == len(good)
    plans += [x._jdf.queryExecution().toString() for x in (done.accepted, done.refused)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_update_and_delete_send_no_batch_through_the_driver(spark):
    stored = _stored(spark, [(k, f"n{k}", "h") for k in range(6)])
    changes = _stored(spark, [(1, "z", "new"), (7, "gone", "h")])
    updated, left = writes.update(GUESTS, stored, changes), writes.delete(GUESTS, stored, changes)
    assert sorted(tuple(r)[1:] for r in updated.collect()) == [("n0", "h"), ("n2", "h"), ("n3", "h"), ("n4", "h"), ("n5", "h"), ("z", "new")]
    assert sorted(r["name"] for r in left.collect()) == ["n0", "n2", "n3", "n4", "n5"]
    for df in (updated, left):
        plan = df._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    few = writes.update(GUESTS, stored, changes, few=True), writes.delete(GUESTS, stored, changes, few=True)
    assert [sorted(df.collect()) for df in few] == [sorted(df.collect()) for df in (updated, left)]


def test_flagship_sends_no_table_through_the_driver(spark, monkeypatch, tmp_path):
    """As for the insert: nothing that grows with a table is broadcast, in any step."""
    from rollcall.plans import queries

    monkeypatch.setattr(writes, "IN_TURN", 0)
    spark.createDataFrame([(k, f"Customer#{k}", "M") for k in range(40)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, f"Supplier#{k}") for k in range(30, 50)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k,) for k in range(5)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    plans = []
    for module in (writes, groups):

        def seen(df, paths=None, settled=module.settled):
            plans.append(df._jdf.queryExecution().toString())
            return settled(df, paths)

        monkeypatch.setattr(module, "settled", seen)
    out = queries.flagship(spark, str(tmp_path))
    # 40 stored, a new one for each of 20 suppliers and one more for the 10 whose ids weren't stored; all 20 ids are renamed, and 5 records leave
    assert out.count() == 40 + 20 + 10 - 5 and out.where("name LIKE 'renamed %'").count() == 20
    plans += [out._jdf.queryExecution().toString()]
    assert plans and not any("Broadcast" in p for p in plans)


def test_connected(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    paths = []
    got = {r["node"]: r["root"] for r in groups.connected(spark.createDataFrame(edges, "u long, v long"), paths).collect()}
    assert got == {x: find(x) for x in list(root)} and len(paths) == 1
    assert groups.connected(spark.createDataFrame([], "u long, v long"), paths).count() == 0


def test_insert_all_refuses_the_batch(spark):
    with pytest.raises(ConstraintViolation, match="name"):
        writes.insert_all(GUESTS, _stored(spark, [(1, "x", "h")]), _rows(spark, [(2, "y", "h"), (3, "x", "h")]))


def test_update_and_delete(spark):
    stored = _stored(spark, [(1, "x", "h"), (2, "y", "h")])
    changes = _stored(spark, [(1, "z", "new"), (7, "gone", "h")])
    assert sorted(tuple(r)[1:] for r in writes.update(GUESTS, stored, changes).collect()) == [("y", "h"), ("z", "new")]
    assert writes.update_echo(GUESTS, changes).count() == 2
    assert writes.affected(GUESTS, stored, changes) == 1
    left = writes.delete(GUESTS, stored, changes.withColumn("name", F.lit("other")))
    assert [r["name"] for r in left.collect()] == ["y"]
    assert writes.delete(GUESTS, stored, changes.where("name = 'gone'")).count() == 2


def test_lookup(spark):
    stored = _stored(spark, [(1, "x", "h"), (2, "y", "h"), (2, "z", "h")])
    assert reads.lookup_one(GUESTS, stored, _id(1))["name"] == "x"
    with pytest.raises(NotFound):
        reads.lookup_one(GUESTS, stored, _id(5))
    with pytest.raises(StoreError):
        reads.lookup_one(GUESTS, stored, _id(2))
    assert reads.lookup(GUESTS, stored, "' OR '1'='1").count() == 0


def test_lookup_reaches_the_scan(spark, tmp_path):
    _stored(spark, [(1, "x", "h")]).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "t"))
    plan = reads.lookup(GUESTS, spark.read.parquet(str(tmp_path / "t")), _id(1))._jdf.queryExecution().toString()
    assert "EqualTo(id," in plan and "ReadSchema: struct<id:string,name:string,hash:string>" in plan


def test_violations(spark):
    rows = _rows(spark, [(1, "x", "h"), (1, "y", "h"), (2, "y", None)])
    assert {(r["rule"], r["n"]) for r in writes.violations(GUESTS, GUESTS.select(rows)).collect()} == {("id", 2), ("name", 2), ("null", 1)}
