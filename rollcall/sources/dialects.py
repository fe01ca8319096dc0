"""What kinds of databases call things, and how they are reached, made and removed."""

from __future__ import annotations

import contextlib
import re
from typing import Any, Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import ConstraintViolation, StatementRefused, StoreError
from .pool import opened

#: Class of SQL states of broken constraints.
VIOLATION = "23"
#: Classes of SQL states that say that a database wasn't reached.
UNREACHED = ("08",)


def _is_sql(cause: Any) -> bool:
    kind = cause.getClass()
    while kind is not None:
        if kind.getName() == "java.sql.SQLException":
            return True
        kind = kind.getSuperclass()
    return False


def sql_state(error: Exception) -> tuple[str, str]:
    """The SQL state and the message of what a driver threw, or of the first cause that has a state; the state may be empty."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    message = ""
    while cause is not None:
        message = message or str(cause.getMessage())
        state = cause.getSQLState() if hasattr(cause, "getSQLState") and _is_sql(cause) else None
        if state:
            return str(state), str(cause.getMessage())
        cause = cause.getCause()
    return "", message or str(error).splitlines()[0]


def store_error(error: Exception, what: str) -> StoreError:
    """A driver's error as one of the registry's."""
    state, message = sql_state(error)
    return (ConstraintViolation if state.startswith(VIOLATION) else StoreError)(f"{what}: {message}")


class Dialect(Protocol):
    #: Types of the columns of a table that the registry makes.
    key_type: str
    text_type: str

    def server(self, connection) -> dict[str, str]:
        """Options of the server, without a database."""

    def database(self, connection) -> dict[str, str]:
        """Options of the database that the settings name."""

    def create(self, spark: SparkSession, connection) -> None:
        """Makes the database; an existing one is refused."""

    def drop(self, spark: SparkSession, connection) -> None:
        """Removes the database; a missing one is refused."""

    def exists(self, spark: SparkSession, connection) -> bool: ...

    def spelt(self, statement: str) -> tuple[str, tuple[str, ...]]:
        """A statement as the database takes it, and the SQL states that then mean that there was nothing to do."""

    def key_text(self, key: str) -> str:
        """The key's column as a text that compares like one."""


def quoted(name: str) -> str:
    if "\0" in name or not name:
        raise StoreError(f"not a name: {name!r}")
    return '"' + name.replace('"', '""') + '"'


def _run(spark: SparkSession, options: dict[str, str], sql: str, what: str) -> None:
    """A statement that no transaction may hold."""
    own = {k: v for k, v in options.items() if k not in ("url", "driver", "numPartitions")}
    try:
        with contextlib.closing(opened(spark, options["url"], own, options.get("driver"))) as connection:
            connection.setAutoCommit(True)
            connection.createStatement().execute(sql)
    except Py4JJavaError as e:
        raise _refused(e, what) from e


def _refused(error: Py4JJavaError, what: str) -> StoreError:
    """Whether a database understood a statement and refused it, or wasn't reached."""
    state, message = sql_state(error)
    known = state and not state.startswith(UNREACHED)
    return (StatementRefused if known else StoreError)(f"{what}: {message}")


class Postgres:
    key_type, text_type = "UUID", "TEXT"

    def server(self, connection) -> dict[str, str]:
        return connection.jdbc(False)

    def database(self, connection) -> dict[str, str]:
        # texts are sent without a type, so that a UUID column takes them
        return connection.jdbc() | {"stringtype": "unspecified"}

    def create(self, spark: SparkSession, connection) -> None:
        _run(spark, self.server(connection), f"CREATE DATABASE {quoted(connection.database)}", f"create {connection.database}")

    def drop(self, spark: SparkSession, connection) -> None:
        _run(spark, self.server(connection), f"DROP DATABASE {quoted(connection.database)}", f"drop {connection.database}")

    def exists(self, spark: SparkSession, connection) -> bool:
        options = self.server(connection)
        own = {k: v for k, v in options.items() if k not in ("url", "numPartitions")}
        try:
            with contextlib.closing(opened(spark, options["url"], own)) as there:
                statement = there.prepareStatement("SELECT 1 FROM pg_database WHERE datname = ?")
                statement.setString(1, connection.database)
                return bool(statement.executeQuery().next())
        except Py4JJavaError as e:
            raise store_error(e, connection.database) from e

    def spelt(self, statement: str) -> tuple[str, tuple[str, ...]]:
        # two that make a table at once may meet in the catalog
        return statement, ("42P07", "23505") if statement.upper().startswith("CREATE TABLE IF NOT EXISTS") else ()

    def key_text(self, key: str) -> str:
        return f"CAST({key} AS TEXT)"


class Derby:
    """The embedded database that Spark brings along: for tests, and for one driver. A database is a folder, or lives in memory."""

    key_type, text_type = "VARCHAR(36)", "VARCHAR(32672)"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    #: What it says of a database that isn't there, and when one was removed.
    MISSING, REMOVED = "XJ004", "08006"

    def __init__(self, folder: str = "memory:"):
        self.folder = folder if folder.endswith(":") else folder.rstrip("/") + "/"

    def _options(self, connection, *attributes: str) -> dict[str, str]:
        if not re.fullmatch(r"[^\x00-\x1f;:/\\]+", connection.database):
            raise StoreError(f"not a database's name: {connection.database!r}")
        url = ";".join([f"jdbc:derby:{self.folder}{connection.database}", *attributes])
        return {"url": url, "driver": self.driver, "user": connection.user, "password": connection.password.reveal()}

    def server(self, connection) -> dict[str, str]:
        raise StoreError("an embedded database has no server")

    def database(self, connection) -> dict[str, str]:
        return self._options(connection)

    def _open(self, spark: SparkSession, connection, *attributes: str) -> None:
        options = self._options(connection, *attributes)
        opened(spark, options["url"], {k: options[k] for k in ("user", "password")}, self.driver).close()

    def exists(self, spark: SparkSession, connection) -> bool:
        try:
            self._open(spark, connection)
            return True
        except Py4JJavaError as e:
            if sql_state(e)[0] == self.MISSING:
                return False
            raise store_error(e, connection.database) from e

    def create(self, spark: SparkSession, connection) -> None:
        if self.exists(spark, connection):
            raise StatementRefused(f"create {connection.database}: it exists already")
        try:
            self._open(spark, connection, "create=true")
        except Py4JJavaError as e:
            raise _refused(e, f"create {connection.database}") from e

    def drop(self, spark: SparkSession, connection) -> None:
        if not self.exists(spark, connection):
            raise StatementRefused(f"drop {connection.database}: it doesn't exist")
        try:
            self._open(spark, connection, "drop=true" if self.folder.startswith("memory:") else "shutdown=true")
        except Py4JJavaError as e:
            if sql_state(e)[0] != self.REMOVED:
                raise _refused(e, f"drop {connection.database}") from e
        if not self.folder.startswith("memory:"):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{self.folder}{connection.database}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def spelt(self, statement: str) -> tuple[str, tuple[str, ...]]:
        # it has no IF EXISTS: what that would pass over is an error that the caller passes over
        for words, states in (("DROP TABLE IF EXISTS", ("42Y55",)), ("CREATE TABLE IF NOT EXISTS", ("X0Y32",))):
            if statement.upper().startswith(words):
                return " ".join(words.split()[:2]) + statement[len(words) :], states
        return statement, ()

    def key_text(self, key: str) -> str:
        return key


POSTGRES = Postgres()
