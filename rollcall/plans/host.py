"""Starting the registry."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..schema import GUESTS, KeyedTable
from ..sources.dialects import POSTGRES, Dialect
from ..sources.jdbc import JdbcStore
from ..sources.snapshot import SnapshotStore
from ..sources.store import Store
from . import databases
from . import migrate as db
from .config import Connection
from .service import Service

log = logging.getLogger("rollcall")


@dataclass(frozen=True)
class Host:
    store: Store
    connection: Connection

    def service(self, strict_paths: bool = False) -> Service:
        return Service(self.store, strict_paths)


def bootstrap_from_env(spark: SparkSession, folder: str, reset: bool = False, env: Mapping[str, str] | None = None, dotenv: str = ".env") -> Host:
    """As ``bootstrap``, with the connection that the environment says; a missing variable is an error before anything is made."""
    return bootstrap(spark, Connection.from_env(env, dotenv), folder, reset)


def bootstrap(spark: SparkSession, connection: Connection, folder: str, reset: bool = False, table: KeyedTable = GUESTS) -> Host:
    """Makes the database and the table where they are missing. With ``reset`` all that they hold is lost first."""
    log.info("database %s at %s:%d", connection.database, connection.host, connection.port)
    store = SnapshotStore(spark, f"{folder.rstrip('/')}/{table.name}", table)
    if reset:
        db.try_drop_database(spark, connection.database)
        store.drop()
    if not spark.catalog.databaseExists(connection.database):
        db.create_database(spark, connection.database)
    db.migrate(spark, connection.database)
    if not store.version():
        store.create()
    return Host(store, connection)


def database_store(spark: SparkSession, connection: Connection, dialect: Dialect = POSTGRES, table: KeyedTable = GUESTS) -> JdbcStore:
    """The store of an existing database; it isn't reached before the first statement. Its pool holds at most five connections."""
    options = dialect.database(connection)
    return JdbcStore(spark, options, table, pool=databases.pool_of(spark, options), dialect=dialect)


def bootstrap_database(spark: SparkSession, connection: Connection, dialect: Dialect = POSTGRES, reset: bool = False, table: KeyedTable = GUESTS) -> Host:
    """Makes the database that the settings name where it is missing, brings it up to date, and gives the store of its table.

    With ``reset`` the database and all that it holds are removed first.
    """
    log.info("database %s at %s:%d", connection.database, connection.host, connection.port)
    if reset:
        databases.try_drop_database(spark, connection, dialect)
    if not dialect.exists(spark, connection):
        databases.create_database(spark, connection, dialect)
    store = database_store(spark, connection, dialect, table)
    databases.migrate(store.pool, [databases.initial(dialect, table)], dialect)
    return Host(store, connection)


def bootstrap_database_from_env(spark: SparkSession, dialect: Dialect = POSTGRES, reset: bool = False, env: Mapping[str, str] | None = None, dotenv: str = ".env") -> Host:
    """As ``bootstrap_database``, with the connection that the environment says; a missing variable is an error before anything is made."""
    return bootstrap_database(spark, Connection.from_env(env, dotenv), dialect, reset)
