"""Databases behind a connection, and their migrations."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import MigrationError, StatementRefused
from ..schema import GUESTS, KeyedTable
from ..sources.dialects import POSTGRES, VIOLATION, Dialect, sql_state, store_error
from ..sources.pool import Pool, opened
from .config import Connection
from .migrate import Migration

JOURNAL = "rollcall_migrations"


def table_statements(dialect: Dialect, table: KeyedTable = GUESTS) -> str:
    """Drops the table and makes it anew, with its rules."""
    columns = [f"{table.key} {dialect.key_type} NOT NULL PRIMARY KEY"]
    columns += [f"{c} {dialect.text_type}{' NOT NULL' if c in table.required else ''}{' UNIQUE' if c in table.unique else ''}" for c in table.others]
    return f"DROP TABLE IF EXISTS {table.name};\nCREATE TABLE IF NOT EXISTS {table.name} ({', '.join(columns)});\n"


def initial(dialect: Dialect, table: KeyedTable = GUESTS) -> Migration:
    return Migration(1, "schema", table_statements(dialect, table))


def create_database(spark: SparkSession, connection: Connection, dialect: Dialect = POSTGRES) -> None:
    """An existing one is an error."""
    dialect.create(spark, connection)


def drop_database(spark: SparkSession, connection: Connection, dialect: Dialect = POSTGRES) -> None:
    """With all that is in it; a missing one is an error."""
    dialect.drop(spark, connection)


def try_drop_database(spark: SparkSession, connection: Connection, dialect: Dialect = POSTGRES) -> bool:
    """Whether it was dropped. A refused statement is no error; a server that isn't reached is one."""
    try:
        dialect.drop(spark, connection)
        return True
    except StatementRefused:
        return False


def pool_of(spark: SparkSession, options: dict[str, str], **more) -> Pool:
    """A pool of the driver's connections; none is made yet."""
    own = {k: v for k, v in options.items() if k not in ("url", "driver", "numPartitions")}
    return Pool(lambda: opened(spark, options["url"], own, options.get("driver")), **more)


def _execute(connection, sql: str, *values, tolerated: tuple[str, ...] = ()) -> bool:
    """Whether a statement ran; the values are bound."""
    try:
        statement = connection.prepareStatement(sql)
        for k, v in enumerate(values):
            statement.setString(k + 1, str(v)) if isinstance(v, str) else statement.setLong(k + 1, int(v))
        statement.execute()
        statement.close()
        return True
    except Py4JJavaError as e:
        if sql_state(e)[0] in tolerated:
            return False
        raise


def _applied(connection, version: int) -> str | None:
    """The checksum of an applied migration."""
    statement = connection.prepareStatement(f"SELECT checksum FROM {JOURNAL} WHERE version = ?")
    statement.setLong(1, version)
    rows = statement.executeQuery()
    out = str(rows.getString(1)) if rows.next() else None
    statement.close()
    return out


def migrate(pool: Pool, migrations: Sequence[Migration], dialect: Dialect = POSTGRES) -> list[int]:
    """Applies what isn't applied yet, in the order of versions, and returns those versions. A changed applied one is an error.

    A migration is one transaction: it claims its version by a row of the journal, whose key
    only one can insert, and runs its statements. Another starter waits for that row and
    finds the migration applied. A failure takes back the statements and the claim, so
    the next start begins with that migration.
    """
    done = []
    try:
        with pool.connection() as connection:
            sql, tolerated = dialect.spelt(f"CREATE TABLE IF NOT EXISTS {JOURNAL} (version BIGINT NOT NULL PRIMARY KEY, name VARCHAR(200) NOT NULL, checksum VARCHAR(64) NOT NULL)")
            if not _execute(connection, sql, tolerated=tolerated):
                connection.rollback()
    except Py4JJavaError as e:
        raise store_error(e, "migrate") from e
    for m in sorted(migrations, key=lambda m: m.version):
        try:
            with pool.connection() as connection:
                applied = _applied(connection, m.version)
                if applied is None:
                    try:
                        _execute(connection, f"INSERT INTO {JOURNAL} (version, name, checksum) VALUES (?, ?, ?)", m.version, m.name, m.checksum())
                    except Py4JJavaError as e:
                        if not sql_state(e)[0].startswith(VIOLATION):
                            raise
                        connection.rollback()
                        applied = _applied(connection, m.version)
                if applied is not None:
                    if applied != m.checksum():
                        raise MigrationError(f"migration {m.version} was changed after it was applied")
                    continue
                for statement in m.statements():
                    sql, tolerated = dialect.spelt(statement.rstrip(";"))
                    _execute(connection, sql, tolerated=tolerated)
            done.append(m.version)
        except Py4JJavaError as e:
            raise MigrationError(f"migration {m.version}: {sql_state(e)[1]}") from e
    return done
