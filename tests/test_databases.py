import json
import threading
import time

import pytest

from rollcall.errors import ConfigError, ConstraintViolation, MigrationError, PoolTimeout, StatementRefused, StoreError
from rollcall.functions.ids import random_id
from rollcall.plans import databases as db
from rollcall.plans.config import Connection, Secret
from rollcall.plans.host import bootstrap_database, bootstrap_database_from_env, database_store
from rollcall.plans.migrate import Migration
from rollcall.schema import GUESTS
from rollcall.sources.dialects import POSTGRES, Derby, quoted
from rollcall.sources.pool import Pool

DERBY = Derby()


@pytest.fixture
def settings():
    return Connection("u", Secret("p"), "embedded", f"db{random_id()[:8]}")


def _record(name, hash="h"):
    return {"id": random_id(), "name": name, "hash": hash}


# bootstrap


def test_one_call_leaves_a_store_that_works(spark, settings):
    env = {"DB_USERNAME": "u", "DB_PASSWORD": "p", "DB_HOST": "embedded", "DB_NAME": settings.database}
    host = bootstrap_database_from_env(spark, DERBY, env=env, dotenv="/nowhere")
    call = host.service().handle
    guest = _record("n")
    head = {"content-type": "application/json"}
    assert call("POST", "/guests", head, json.dumps(guest))[0] == 200
    assert json.loads(call("GET", "/guests")[2]) == [guest]
    assert call("POST", "/guests", head, json.dumps(guest))[0] == 400
    assert call("PUT", f"/guests/{guest['id']}", head, json.dumps(guest | {"hash": "x"}))[0] == 200
    assert json.loads(call("GET", f"/guests/{guest['id']}")[2])["hash"] == "x"
    assert call("GET", "/book")[2].startswith("Apache Derby")
    # another start keeps the rows, a reset doesn't
    assert bootstrap_database(spark, host.connection, DERBY).store.get_all().count() == 1
    assert bootstrap_database(spark, host.connection, DERBY, reset=True).store.get_all().count() == 0
    with pytest.raises(ConfigError):
        bootstrap_database_from_env(spark, DERBY, env={}, dotenv="/nowhere")


def test_a_database_in_a_folder(spark, settings, tmp_path):
    dialect = Derby(str(tmp_path))
    host = bootstrap_database(spark, settings, dialect)
    host.store.insert(_record("a"))
    host.store.pool.close()
    assert (tmp_path / settings.database).is_dir()
    db.drop_database(spark, settings, dialect)
    assert not (tmp_path / settings.database).exists()
    assert not db.try_drop_database(spark, settings, dialect)


def test_databases(spark, settings):
    with pytest.raises(StatementRefused):
        db.drop_database(spark, settings, DERBY)
    assert not db.try_drop_database(spark, settings, DERBY) and not DERBY.exists(spark, settings)
    db.create_database(spark, settings, DERBY)
    assert DERBY.exists(spark, settings)
    with pytest.raises(StatementRefused):
        db.create_database(spark, settings, DERBY)
    assert db.try_drop_database(spark, settings, DERBY) and not DERBY.exists(spark, settings)
    for name in ("x;drop=true", "a/b", ""):
        with pytest.raises(StoreError):
            db.create_database(spark, settings.with_database(name), DERBY)


def test_a_server_that_is_not_reached_is_no_refusal(spark, settings):
    # no driver for it is here, which is as good as no server
    for call in (db.create_database, db.drop_database, db.try_drop_database):
        with pytest.raises(StoreError) as e:
            call(spark, settings, POSTGRES)
        assert not isinstance(e.value, StatementRefused)


def test_names_are_names(settings):
    assert quoted('a"; DROP DATABASE b; --') == '"a""; DROP DATABASE b; --"'
    assert settings.with_database("d?user=other&x=/y").jdbc()["url"].endswith("/d%3Fuser%3Dother%26x%3D%2Fy")
    with pytest.raises(StoreError):
        quoted("")
    assert POSTGRES.database(settings)["stringtype"] == "unspecified" and POSTGRES.key_text("id") == "CAST(id AS TEXT)"
    assert "id UUID NOT NULL PRIMARY KEY, name TEXT NOT NULL UNIQUE, hash TEXT NOT NULL" in db.table_statements(POSTGRES)


# batches


def test_long_values_pass_in_batches(spark, settings):
    store = bootstrap_database(spark, settings, DERBY).store
    frame = lambda *records: spark.createDataFrame([tuple(r[c] for c in GUESTS.columns) for r in records], "id string, name string, hash string")
    a, b = _record("a", "x" * 20_000), _record("b" * 5_000, "y")
    assert store.insert(a)["hash"] == a["hash"]
    assert store.insert_many(frame(b)) == 1
    assert store.update_many(frame(a | {"hash": "z" * 30_000})) == 1
    assert store.get(a["id"])["hash"] == "z" * 30_000 and store.get(b["id"])["name"] == b["name"]
    assert store.delete_many(frame(a, b)) == 2


def test_no_staging_table_stays_and_the_first_error_counts(spark, settings, monkeypatch):
    store = bootstrap_database(spark, settings, DERBY).store
    tables = lambda: spark.read.format("jdbc").options(**store.options).option("query", "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").load().collect()
    a = _record("a")
    rows = spark.createDataFrame([tuple(a.values()), tuple(_record("a").values())], "id string, name string, hash string")
    before = len(tables())
    with pytest.raises(ConstraintViolation):
        store.insert_many(rows)
    assert len(tables()) == before
    run = store._run
    monkeypatch.setattr(store, "_run", lambda sql, *v: run("DROP TABLE nothing") if sql.startswith("DROP") else run(sql, *v))
    with pytest.raises(ConstraintViolation):
        store.insert_many(rows)


# migrations


def _migrations(*sql):
    return [db.initial(DERBY)] + [Migration(k + 2, f"m{k}", s) for k, s in enumerate(sql)]


@pytest.fixture
def pool(spark, settings):
    db.create_database(spark, settings, DERBY)
    out = db.pool_of(spark, DERBY.database(settings), wait_s=60)
    yield out
    out.close()
    db.try_drop_database(spark, settings, DERBY)


def _tables(pool, name):
    with pool.connection() as c:
        rows = c.getMetaData().getTables(None, None, name.upper(), None)
        return bool(rows.next())


def test_migrations_are_applied_once(pool):
    more = _migrations("CREATE TABLE extra (x INT);\nINSERT INTO extra VALUES (1)")
    assert db.migrate(pool, _migrations(), DERBY) == [1] and db.migrate(pool, more, DERBY) == [2] and db.migrate(pool, more, DERBY) == []
    with pytest.raises(MigrationError, match="changed"):
        db.migrate(pool, _migrations("CREATE TABLE other (x INT)"), DERBY)
    assert not _tables(pool, "other")


def test_a_failure_leaves_nothing_and_the_next_start_goes_on(pool):
    db.migrate(pool, _migrations(), DERBY)
    with pytest.raises(MigrationError):
        db.migrate(pool, _migrations("CREATE TABLE one (x INT);\nDROP TABLE guests;\nthis is no statement"), DERBY)
    assert _tables(pool, "guests") and not _tables(pool, "one")
    assert db.migrate(pool, _migrations("CREATE TABLE one (x INT)"), DERBY) == [2] and _tables(pool, "one")


def test_two_starters_apply_once(pool):
    # a second application would fail, as the table is there
    steps = _migrations("CREATE TABLE one (x INT)", "CREATE TABLE two (x INT);\nINSERT INTO two VALUES (1)")
    applied, errors = [], []

    def start():
        try:
            applied.extend(db.migrate(pool, steps, DERBY))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=start) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not errors and sorted(applied) == [1, 2, 3]


# the pool


class Fake:
    def __init__(self):
        self.valid, self.log = True, []

    def isValid(self, _):
        return self.valid

    def __getattr__(self, name):
        return lambda *a: self.log.append(name)


def test_the_pool_is_lazy_and_bounded():
    made = []
    pool = Pool(lambda: made.append(Fake()) or made[-1], size=5, wait_s=0.3)
    assert not made
    taken = [pool.connection() for _ in range(5)]
    first = [t.__enter__() for t in taken]
    assert len(made) == 5 == len(set(map(id, first)))
    began = time.monotonic()
    with pytest.raises(PoolTimeout):
        pool.connection().__enter__()
    assert 0.25 < time.monotonic() - began < 2
    # a waiter gets what comes back
    got = []
    waiter = threading.Thread(target=lambda: got.append(pool.connection().__enter__()))
    pool.wait_s = 10
    waiter.start()
    taken[2].__exit__(None, None, None)
    waiter.join(5)
    assert got == [first[2]] and len(made) == 5


def test_connections_are_used_again_and_dead_ones_replaced():
    made = []
    pool = Pool(lambda: made.append(Fake()) or made[-1], size=1, wait_s=0.2)
    with pool.connection() as a:
        pass
    with pytest.raises(KeyError):
        with pool.connection() as b:
            raise KeyError
    assert a is b and a.log == ["setAutoCommit", "commit", "rollback"]
    a.valid = False
    with pool.connection() as c:
        assert c is not a and pool.made == 1
    pool.close()
    assert c.log[-1] == "close" and pool.made == 0
    with pytest.raises(StoreError):
        pool.connection().__enter__()


def test_a_failed_connection_gives_its_place_free():
    def broken():
        raise OSError("no route")

    pool = Pool(broken, size=1, wait_s=0.2)
    for _ in range(3):
        with pytest.raises(OSError):
            pool.connection().__enter__()
    assert pool.made == 0


def test_a_store_keeps_its_connections(spark, settings):
    store = bootstrap_database(spark, settings, DERBY).store
    for k in range(4):
        store.insert(_record(f"n{k}"))
    assert store.pool.made == 1 and store.pool.size == 5 and store.pool.wait_s == 3
    # nothing is reached before the first statement
    lazy = database_store(spark, settings.with_database("nowhere"), DERBY)
    assert lazy.pool.made == 0
    with pytest.raises(StoreError):
        lazy.insert(_record("a"))
