import json
import re

import pytest

from rollcall.errors import ConfigError, MigrationError, StoreError
from rollcall.functions import generate
from rollcall.functions.ids import random_id
from rollcall.plans import migrate as db
from rollcall.plans.config import Connection, Secret
from rollcall.plans.host import bootstrap
from rollcall.plans.service import CLIENT

ENV = {"DB_USERNAME": "u", "DB_PASSWORD": "p@ss", "DB_HOST": "h", "DB_NAME": "rollcall_test"}
HEAD = {"Content-Type": "application/json"}


@pytest.fixture
def host(spark, tmp_path):
    yield bootstrap(spark, Connection.from_env(ENV), f"file://{tmp_path}", reset=True)
    db.try_drop_database(spark, "rollcall_test")


def test_guests(host):
    call = host.service().handle
    assert call("GET", "/guests") == (200, {"content-type": "application/json"}, "[]")
    guest = {"id": random_id(), "name": "n", "hash": "h"}
    body = json.dumps(guest)
    status, _, out = call("POST", "/guests", HEAD, body)
    assert status == 200 and json.loads(out) == guest
    assert json.loads(call("GET", "/guests")[2]) == [guest]
    assert json.loads(call("GET", f"/guests/{guest['id'].upper()}")[2]) == guest
    assert call("POST", "/guests", HEAD, body)[0] == 400
    other = json.dumps(guest | {"name": "m"})
    assert call("PUT", f"/guests/{random_id()}", HEAD, other)[0] == 200
    assert host.service(strict_paths=True).handle("PUT", f"/guests/{random_id()}", HEAD, other)[0] == 400
    assert json.loads(call("GET", f"/guests/{guest['id']}")[2])["name"] == "m"
    assert call("DELETE", f"/guests/{random_id()}", HEAD, body) == (200, {}, "")
    assert call("GET", f"/guests/{guest['id']}")[0] == 400
    assert call("GET", "/guests/12")[0] == 400
    assert call("POST", "/guests", HEAD, "{")[0] == 400
    assert call("POST", "/guests", HEAD, "{}")[0] == 422
    assert call("POST", "/guests", {}, body)[0] == 415
    assert call("PATCH", "/guests")[0] == 405
    assert call("GET", "/nothing")[0] == 404


def test_others(host):
    call = host.service().handle
    assert call("GET", "/health") == (200, {"access-control-allow-origin": CLIENT}, "")
    status, headers, version = call("GET", "/book")
    assert status == 200 and headers["access-control-allow-origin"] == CLIENT and version[0].isdigit()
    assert re.fullmatch("[a-z]+-[a-z]+", call("GET", "/improv/name")[2])
    assert re.fullmatch(r"[a-z]+-[a-z]+-\d{4}", call("GET", "/improv/name/num")[2])
    assert len(call("GET", "/improv/pass")[2]) == 8
    config = {"length": 20, "numbers": False, "lowercase": False, "uppercase": True, "symbols": True, "spaces": True, "exclude": True, "strict": True}
    status, _, word = call("POST", "/improv/pass", HEAD, json.dumps(config))
    assert status == 200 and len(word) == 20
    assert call("POST", "/improv/pass", HEAD, json.dumps(config | {"length": 2}))[0] == 400
    assert call("POST", "/improv/pass", HEAD, json.dumps(config | {"length": "2"}))[0] == 422


def test_bootstrap_keeps_and_resets(spark, host, tmp_path):
    host.store.insert({"id": random_id(), "name": "n", "hash": "h"})
    assert bootstrap(spark, host.connection, f"file://{tmp_path}").store.get_all().count() == 1
    assert bootstrap(spark, host.connection, f"file://{tmp_path}", reset=True).store.get_all().count() == 0


def test_databases(spark):
    name = "another"
    with pytest.raises(StoreError):
        db.create_database(spark, "x; DROP DATABASE default")
    db.create_database(spark, name)
    with pytest.raises(StoreError):
        db.create_database(spark, name)
    assert db.try_drop_database(spark, name) and not db.try_drop_database(spark, name)
    with pytest.raises(StoreError):
        db.drop_database(spark, name)


def test_migrations(spark):
    db.create_database(spark, "m1")
    try:
        assert db.migrate(spark, "m1") == [1] and db.migrate(spark, "m1") == []
        more = [db.INITIAL, db.Migration(2, "more", "CREATE TABLE extra (x INT) USING parquet")]
        assert db.migrate(spark, "m1", more) == [2]
        with pytest.raises(MigrationError):
            db.migrate(spark, "m1", [db.Migration(1, "schema", "SELECT 1")])
        with pytest.raises(MigrationError):
            db.migrate(spark, "m1", [*more, db.Migration(3, "bad", "this is no statement")])
        assert spark.catalog.currentDatabase() == "default"
    finally:
        db.try_drop_database(spark, "m1")


@pytest.fixture
def empty_database(spark):
    db.create_database(spark, "m2")
    yield "m2"
    db.try_drop_database(spark, "m2")


def test_a_failed_migration_goes_on_where_it_failed(spark, empty_database):
    first = "CREATE TABLE once (x INT) USING parquet;\nINSERT INTO once VALUES (1);\n"
    with pytest.raises(MigrationError):
        db.migrate(spark, "m2", [db.Migration(1, "m", first + "this is no statement")])
    # what ran isn't run again, or the table would exist already; what ran can't be changed
    with pytest.raises(MigrationError, match="changed"):
        db.migrate(spark, "m2", [db.Migration(1, "m", first.replace("x INT", "y INT") + "SELECT 1")])
    assert db.migrate(spark, "m2", [db.Migration(1, "m", first + "INSERT INTO once VALUES (2)")]) == [1]
    assert sorted(r["x"] for r in spark.table("m2.once").collect()) == [1, 2]


def test_of_two_starters_one_applies(spark, empty_database):
    import threading

    steps = [db.Migration(1, "a", "CREATE TABLE a (x INT) USING parquet;\nINSERT INTO a VALUES (1)"), db.Migration(2, "b", "CREATE TABLE b (x INT) USING parquet")]
    applied, errors = [], []

    def start():
        try:
            applied.extend(db.migrate(spark, "m2", steps, wait_s=200))
        except Exception as e:
            errors.append(e)

    db.migrate(spark, "m2", [])
    threads = [threading.Thread(target=start) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not errors and sorted(applied) == [1, 2] and spark.table("m2.a").count() == 1


def test_the_claim_of_a_dead_starter_ends(spark, empty_database):
    step = [db.Migration(1, "a", "CREATE TABLE a (x INT) USING parquet")]
    assert db._Journal(spark, "m2", 1).claimed(600) == 1
    with pytest.raises(MigrationError, match="elsewhere"):
        db.migrate(spark, "m2", step, wait_s=0.3)
    assert db.migrate(spark, "m2", step, lease_s=0.1) == [1]


@pytest.mark.parametrize("missing", list(ENV))
def test_missing_setting(missing):
    with pytest.raises(ConfigError, match=missing):
        Connection.from_env({k: v for k, v in ENV.items() if k != missing}, dotenv="/nowhere")


def test_connection(tmp_path):
    (tmp_path / ".env").write_text("# c\nDB_NAME='other'\nDB_HOST=x\n")
    c = Connection.from_env({k: v for k, v in ENV.items() if k != "DB_NAME"}, dotenv=str(tmp_path / ".env"))
    assert (c.database, c.host, c.port) == ("other", "h", 5432)
    assert c.dsn().reveal() == "postgres://u:p@ss@h:5432/other" and c.server_dsn().reveal() == "postgres://u:p@ss@h:5432"
    assert "p@ss" not in repr(c) and str(Secret("x")) == "Secret(***)"
    assert c.jdbc()["sslmode"] == "prefer" and c.jdbc(False)["url"].endswith("5432/")
    assert Connection.from_mapping({"name": "u", "pass": "p", "host": 12, "database": "d", "port": "99", "ssl": True}).host == "12"
    with pytest.raises(ConfigError):
        Connection("u", Secret("p"), "h", "d", 70000)


def test_settings_are_read_strictly():
    good = {"name": "u", "pass": "p", "host": "h", "database": "d", "port": 5432, "ssl": "false"}
    assert Connection.from_mapping(good).ssl is False and Connection.from_mapping(good | {"ssl": "TRUE"}).ssl is True
    for bad in ({"ssl": "no"}, {"ssl": 1}, {"ssl": None}, {"port": None}, {"port": "x"}, {"port": 70000}, {"port": True}, {"name": None}):
        with pytest.raises(ConfigError):
            Connection.from_mapping(good | bad)


def test_only_refused_statements_are_tolerated(spark, monkeypatch):
    from pyspark.errors import AnalysisException

    class Broken:
        def sql(self, *_):
            raise AnalysisException("the metastore can't be reached")

    with pytest.raises(StoreError):
        db.try_drop_database(Broken(), "x")


def test_pages(host):
    call = host.service().handle
    assert call("GET", "/guests?limit=2") == (200, {"content-type": "application/json"}, "[]")
    guests = [generate.secure_record() | {"name": f"n{k}"} for k in range(7)]
    host.store.insert_many(host.store.spark.createDataFrame([tuple(g.values()) for g in guests], "id string, name string, hash string"))
    seen, path = [], "/guests?limit=3"
    while path:
        status, headers, body = call("GET", path)
        rows = json.loads(body)
        assert status == 200 and (len(rows) == 3 or "x-next" not in headers)
        seen += rows
        if path == "/guests?limit=3":  # what comes later isn't in the pages of an older version
            host.store.insert(generate.secure_record() | {"name": "late"})
        path = f"/guests?limit=3&after={headers['x-next']}" if "x-next" in headers else None
    assert sorted(r["name"] for r in seen) == [f"n{k}" for k in range(7)]
    assert len(json.loads("".join(host.service().stream_all()))) == 8
    for bad in ("limit=0", "limit=x", "after=x", "limit=99999999", "after=99.1.x", "after=1.x.y"):
        assert call("GET", f"/guests?{bad}")[0] == 400


def test_stream(host):
    import json

    service = host.service()
    assert "".join(service.stream_all()) == "[]"
    for name in ("a", "b"):
        host.store.insert(generate.secure_record() | {"name": name})
    assert sorted(x["name"] for x in json.loads("".join(service.stream_all()))) == ["a", "b"]
