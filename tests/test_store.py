import pytest
from pyspark.sql import functions as F

from rollcall.errors import ConstraintViolation, NotFound, StoreError, WriteConflict
from rollcall.functions.ids import random_id
from rollcall.plans.host import bootstrap_database_from_env
from rollcall.sources.dialects import Derby
from rollcall.sources.jdbc import JdbcStore
from rollcall.sources.snapshot import SnapshotStore
from rollcall.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    out = SnapshotStore(spark, f"file://{tmp_path}/guests", wait_s=0.5)
    out.create()
    return out


def _record(name, hash="h"):
    return {"id": random_id(), "name": name, "hash": hash}


def test_lifecycle(store):
    a = _record("a")
    assert store.insert(a).asDict() == a
    assert store.update(a | {"name": "b"})["name"] == "b"
    assert store.get(a["id"])["name"] == "b"
    store.delete({"id": a["id"], "name": "not looked at", "hash": ""})
    with pytest.raises(NotFound):
        store.get(a["id"])
    assert store.get_all().count() == 0


def test_missing_keys_change_nothing(store):
    a = _record("a")
    store.insert(a)
    version = store.version()
    assert store.update(_record("z"))["name"] == "z"
    store.delete(_record("z"))
    assert store.version() == version and [r.asDict() for r in store.get_all().collect()] == [a]


def test_rules(store):
    a = _record("a")
    store.insert(a)
    for bad in (a | {"name": "other"}, _record("a"), {"id": random_id(), "name": "b", "hash": None}):
        with pytest.raises(ConstraintViolation):
            store.insert(bad)
    store.insert(_record("c"))
    with pytest.raises(ConstraintViolation):
        store.update(a | {"name": "c"})
    with pytest.raises(ConstraintViolation):
        store.update(a | {"hash": None})
    assert sorted(r["name"] for r in store.get_all().collect()) == ["a", "c"]


def test_readers_keep_their_version(store):
    store.insert(_record("a"))
    before = store.read()
    store.insert(_record("b"))
    assert (before.count(), store.read().count()) == (1, 2)


def test_the_second_of_two_writers_fails(store):
    base = store.version()
    rows = store.read(base)
    store.replace(rows, base)
    with pytest.raises(WriteConflict):
        store.replace(rows, base)


def test_a_failed_write_leaves_the_table(spark, store):
    store.insert(_record("a"))
    base = store.version()
    with pytest.raises(Exception):
        store.replace(store.read().selectExpr("id", "name", "raise_error('x') AS hash"), base)
    assert store.version() == base and store.get_all().count() == 1
    store._mark("claims", base + 1)
    with pytest.raises(WriteConflict):
        store.insert(_record("b"))
    assert store.recover() == [base + 1]
    store.insert(_record("b"))


def test_create_twice(store):
    with pytest.raises(StoreError):
        store.create()


def _frame(spark, *records):
    return spark.createDataFrame([tuple(r[c] for c in ("id", "name", "hash")) for r in records], "id string, name string, hash string")


def test_an_insert_writes_its_rows_alone(store, spark):
    a, b = _record("a"), _record("b")
    store.insert(a)
    assert store.insert_many(_frame(spark, b)) == 1
    n = store.version()
    assert len(store.folders(n)) == 2 and spark.read.parquet(f"{store.path}/v{n}").count() == 1
    assert sorted(r["name"] for r in store.get_all().collect()) == ["a", "b"]


def test_a_change_writes_its_bucket_alone(store, spark):
    records = [_record(f"n{k}") for k in range(400)]
    store.insert_many(_frame(spark, *records))
    before = store.folders(store.version())
    assert len(before) == 16
    one = records[7]
    store.update(one | {"hash": "new"})
    n = store.version()
    new = [x for x in store.folders(n) if x not in before]
    # the bucket's rows were written, and no others
    assert len(new) == 1 and new[0].startswith(f"v{n}/") and len(store.folders(n)) == 16
    written = spark.read.schema(store.table.schema).parquet(f"{store.path}/v{n}").collect()
    assert 5 < len(written) < 80 and sum(r["hash"] == "new" for r in written) == 1
    assert store.get(one["id"])["hash"] == "new" and store.get_all().count() == 400
    assert store.delete_many(_frame(spark, one)) == 1
    kept = set(store.folders(n)) & set(store.folders(store.version()))
    assert len(kept) == 15 and store.get_all().count() == 399
    # names may be taken from rows of other buckets if those give them up, else not
    with pytest.raises(ConstraintViolation):
        store.update(records[8] | {"name": "n9"})
    assert store.update_many(_frame(spark, records[8] | {"name": "n9"}, records[9] | {"name": "n8"})) == 2
    assert store.delete_many(_frame(spark, *records)) == 399 and store.get_all().count() == 0
    assert store.folders(store.version()) == []
    store.insert(one)
    gone = store.vacuum()
    assert len(gone) >= 18 and store.get_all().count() == 1


def test_a_page_reads_one_bucket(store, spark, monkeypatch):
    store.insert_many(_frame(spark, *[_record(f"n{k}") for k in range(200)]))
    asked = []
    read = store._rows_in
    monkeypatch.setattr(store, "_rows_in", lambda folders: asked.append(folders) or read(folders))
    rows, after = store.page(None, 4)
    assert len(rows) == 4 and len(asked) == 1 and len(asked[0]) == 1
    asked.clear()
    more, _ = store.page(after, 4)
    assert len(asked) == 1 and len(asked[0]) == 1 and not {r["id"] for r in rows} & {r["id"] for r in more}


def test_full_buckets_are_written_anew(store, spark, monkeypatch):
    from rollcall.sources import snapshot

    monkeypatch.setattr(snapshot, "MAX_FOLDERS", 3)
    for k in range(4):
        store.insert_many(_frame(spark, *[_record(f"{k} {i}") for i in range(40)]))
    listed = store.folders(store.version())
    assert max(sum(store._bucket_of(x) == b for x in listed) for b in range(16)) <= 3 and store.get_all().count() == 160


def _scanned(rows):
    """Rows that came out of the files."""
    rows.collect()
    node = rows._jdf.queryExecution().executedPlan()
    leaves = node.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_a_lookup_reads_the_row_groups_that_may_hold_the_value(spark, tmp_path, monkeypatch):
    from rollcall.functions.ids import keyed_id
    from rollcall.operators import reads

    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "65536")
    try:
        store = SnapshotStore(spark, f"file://{tmp_path}/large", buckets=2)
        store.create()
        k = F.col("id").cast("string")
        # names are in no order within the files
        rows = spark.range(20_000).select(keyed_id(k).alias("id"), F.concat(F.lit("n"), F.md5(k)).alias("name"), F.md5(F.concat(k, k)).alias("hash"))
        store.insert_many(rows)
    finally:
        hadoop.unset("parquet.block.size")
    stored = store.read()
    name = rows.first()["name"]
    by_name = stored.where(F.col("name") == name)
    assert by_name.count() == 1 and _scanned(by_name) < 5_000
    assert _scanned(stored.where(F.col("name") == "n0")) < 5_000
    key = rows.first()["id"]
    assert store.get(key)["name"] == name
    assert _scanned(reads.lookup(store.table, store.read(buckets=store._buckets_of(rows.limit(1))), key)) < 3_000
    with pytest.raises(ConstraintViolation):
        store.insert({"id": random_id(), "name": name, "hash": "h"})


def test_writers_of_other_rows_both_succeed(spark, tmp_path):
    import threading

    path = f"file://{tmp_path}/guests"
    SnapshotStore(spark, path).create()
    errors = []

    def write(k):
        try:
            own = SnapshotStore(spark, path, wait_s=60)
            own.insert_many(_frame(spark, _record(f"a{k}"), _record(f"b{k}")))
            own.insert(_record(f"c{k}"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not errors
    assert sorted(r["name"] for r in SnapshotStore(spark, path).get_all().collect()) == sorted(f"{x}{k}" for x in "abc" for k in range(3))


def test_a_second_writer_is_checked_against_what_the_first_added(spark, store, monkeypatch):
    """The first commits between the second's check and its commit."""
    other = SnapshotStore(spark, store.path)
    append, seen = store._append, []

    def late(rows, base):
        if not seen:
            seen.append(base)
            other.insert(_record("x"))
        return append(rows, base)

    monkeypatch.setattr(store, "_append", late)
    checked = []
    rows_in = store._rows_in
    monkeypatch.setattr(store, "_rows_in", lambda folders: checked.append(list(folders)) or rows_in(folders))
    assert store.insert_many(_frame(spark, _record("y"))) == 1
    assert len(checked[-1]) == 1  # the folder of the other's row
    seen.clear()
    with pytest.raises(ConstraintViolation):
        monkeypatch.setattr(other, "insert", lambda _: SnapshotStore(spark, store.path).insert_many(_frame(spark, _record("z"))))
        store.insert(_record("z"))
    assert sorted(r["name"] for r in store.get_all().collect()) == ["x", "y", "z"]


def test_what_must_have_a_value_is_read_so(spark, store):
    from rollcall.schema import RECORD

    store.insert(_record("a"))
    assert store.get_all().schema == RECORD and store.get_all().where("name = 'a'").count() == 1
    some = store.get_all(F.col("name") == "a")
    assert some.schema == RECORD
    plan = some._jdf.queryExecution().toString()
    n = store.version()
    spark.createDataFrame([(random_id(), None, "h")], "id string, name string, hash string").write.mode("append").parquet(f"{store.path}/{store.folders(n)[0]}")
    with pytest.raises(Exception, match="name has no value"):
        store.get_all().collect()
    assert "EqualTo(name,a)" in plan


def test_a_batch_leaves_no_table_behind(spark, store):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    a = _record("a")
    store.insert_many(_frame(spark, a, _record("b")))
    store.update_many(_frame(spark, a | {"name": "c"}))
    store.delete_many(_frame(spark, a))
    with pytest.raises(ConstraintViolation):
        store.insert_many(_frame(spark, a, a))
    assert set(os.listdir(shared)) == before


OPTIONS = {"url": "jdbc:derby:memory:{name};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(params=["snapshot", "jdbc", "jdbc-ranges", "bootstrapped"])
def any_store(request, spark, tmp_path):
    if request.param == "snapshot":
        out = SnapshotStore(spark, f"file://{tmp_path}/guests")
    elif request.param == "bootstrapped":
        env = {"DB_USERNAME": "u", "DB_PASSWORD": "p", "DB_HOST": "embedded", "DB_NAME": f"db{random_id()[:8]}"}
        out = bootstrap_database_from_env(spark, Derby(), env=env, dotenv="/nowhere").store
        yield out
        out.drop()
        return
    else:
        out = JdbcStore(spark, OPTIONS | {"url": OPTIONS["url"].format(name=random_id()[:8])}, partitions=5 if request.param == "jdbc-ranges" else 1)
    out.create()
    yield out
    out.drop()


def test_every_store_keeps_the_contract(spark, any_store):
    store = any_store
    assert isinstance(store, Store)
    frame = lambda *records: spark.createDataFrame([tuple(r[c] for c in ("id", "name", "hash")) for r in records], "id string, name string, hash string")
    a, b, c, d = (_record(x) for x in "abcd")
    assert store.insert(a).asDict() == a
    store.insert_many(frame(b, c))
    names = lambda: sorted(r["name"] for r in store.get_all().collect())
    assert names() == ["a", "b", "c"] and store.get_all().schema == store.table.schema
    pages, after = [], None
    for _ in range(3):
        rows, after = store.page(after, 1)
        pages += rows
    assert after is None and sorted(r["name"] for r in pages) == ["a", "b", "c"]
    assert sorted(r["name"] for r in store.page(None, 10)[0]) == ["a", "b", "c"] and store.server_version()
    # a batch is stored whole or not at all, a record that breaks a rule never
    for bad in (_record("a"), a | {"name": "z"}, d | {"hash": None}):
        with pytest.raises(ConstraintViolation):
            store.insert(bad)
        with pytest.raises(ConstraintViolation):
            store.insert_many(frame(d, bad))
        assert names() == ["a", "b", "c"]
    with pytest.raises(NotFound):
        store.get(d["id"])
    assert store.update(d) == d and names() == ["a", "b", "c"]
    # names may be exchanged by a batch
    assert store.update_many(frame(a | {"name": "b"}, b | {"name": "a"}, d)) == 2
    assert store.get(a["id"])["name"] == "b" and names() == ["a", "b", "c"]
    with pytest.raises(ConstraintViolation):
        store.update_many(frame(a | {"name": "c"}))
    with pytest.raises(StoreError):
        store.update_many(frame(a, a))
    assert store.delete_many(frame(a, d).select("id")) == 1 and names() == ["a", "c"]
    store.delete({"id": b["id"]})
    store.delete(d)
    assert [r.asDict() for r in store.get_all().collect()] == [c]


def test_connection_options_reach_every_statement(spark):
    from rollcall.plans.config import Connection, Secret

    store = JdbcStore.from_connection(spark, Connection("u", Secret("p"), "h", "d", ssl=True), fetchsize="10")
    given = store.connection_properties()
    assert given["sslmode"] == "require" and given["user"] == "u" and given["password"] == "p" and "ApplicationName" in given
    assert not {"url", "numPartitions", "fetchsize", "driver"} & set(given)
    assert store.partitions == 5


def test_a_database_out_of_reach_is_no_violation(spark):
    store = JdbcStore(spark, {"url": "jdbc:derby:memory:nothing-here", "driver": OPTIONS["driver"]})
    for call in (lambda: store.insert(_record("a")), lambda: store.insert_many(spark.createDataFrame([("a", "b", "c")], "id string, name string, hash string"))):
        with pytest.raises(StoreError) as e:
            call()
        assert not isinstance(e.value, ConstraintViolation)


def test_ranges_of_keys_meet_each_row_once(spark):
    for n in (1, 2, 5, 16):
        store = JdbcStore(spark, dict(OPTIONS), partitions=n)
        keys = spark.createDataFrame([(x,) for x in ["", "0", "0a", "3f", "9", "A1", "a", "b0", "f", "ff", "zz", "é"]] + [(None,)], "id string")
        ranges = store._ranges() or ["true"]
        assert [sum(bool(r[k]) for k in range(len(ranges))) for r in keys.selectExpr(*ranges).collect()] == [1] * 13


def test_jdbc(spark, tmp_path):
    options = {"url": "jdbc:derby:memory:rollcall;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    store = JdbcStore(spark, options)
    store.create()
    a, b = _record("a"), _record("b")
    assert store.insert(a).asDict() == a
    store.insert_many(spark.createDataFrame([tuple(b.values())], "id string, name string, hash string"))
    with pytest.raises(ConstraintViolation):
        store.insert(_record("b"))
    store.update(a | {"name": "c"})
    assert store.get(a["id"])["name"] == "c"
    store.delete(a)
    assert [r.asDict() for r in store.get_all().collect()] == [b]
    plan = store.get_all(F.col("id") == b["id"])._jdf.queryExecution().toString()
    assert "EqualTo(ID," in plan
    store.drop()
