"""Databases and their migrations, as Spark SQL."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import MigrationError, StatementRefused, StoreError
from ..sources.files import made_first

APPLIED = "_applied_migrations"
#: Where a database's journal is, beside its tables.
FOLDER = "_migrations"


def _refused(error: PySparkException) -> bool:
    """Whether a statement was refused with a condition that Spark names; a metastore that can't be reached is another matter."""
    condition = error.getCondition() or ""
    return isinstance(error, (AnalysisException, ParseException)) and bool(condition) and not condition.startswith("_LEGACY_ERROR")


def create_database(spark: SparkSession, name: str) -> None:
    """An existing one is an error."""
    _database(spark, "CREATE DATABASE IDENTIFIER(:db)", name)


def drop_database(spark: SparkSession, name: str) -> None:
    """With all that is in it; a missing one is an error."""
    _database(spark, "DROP DATABASE IDENTIFIER(:db) CASCADE", name)


def _database(spark: SparkSession, statement: str, name: str) -> None:
    try:
        spark.sql(statement, {"db": f"`{name.replace('`', '``')}`"})
    except PySparkException as e:
        raise (StatementRefused if _refused(e) else StoreError)(f"{statement.split()[0].lower()} {name}: {e.getCondition()}") from e


def try_drop_database(spark: SparkSession, name: str) -> bool:
    """Whether it was dropped. A refused statement is no error; that the catalog can't be reached is one."""
    try:
        drop_database(spark, name)
        return True
    except StatementRefused:
        return False


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    #: statements, separated by semicolons at line ends
    sql: str

    def statements(self) -> list[str]:
        return [s.strip() for s in self.sql.replace(";\n", ";\0").split(";\0") if s.strip().strip(";")]

    def checksum(self) -> str:
        return hashlib.sha256(self.sql.encode()).hexdigest()


#: Drops the table and makes it anew. Keys and unique columns are held by the operators, for Parquet tables know none.
INITIAL = Migration(1, "schema", "DROP TABLE IF EXISTS guests;\nCREATE TABLE IF NOT EXISTS guests (id STRING NOT NULL, name STRING NOT NULL, hash STRING NOT NULL) USING parquet;\n")


class _Journal:
    """Files beside a database's tables, which only one starter can create: who has claimed a migration, and which of its statements are done.

    A catalog has no transactions, so a starter that fails gives its claim free and leaves the list
    of what is done; one that dies leaves its claim, which counts for ``lease_s`` seconds.
    """

    def __init__(self, spark: SparkSession, database: str, version: int):
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self.folder = f"{spark.catalog.getDatabase(f'`{database.replace("`", "``")}`').locationUri}/{FOLDER}/{version}"
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _files(self) -> dict[str, int]:
        """Names, and when they were made (in milliseconds)."""
        return {x.getPath().getName(): x.getModificationTime() for x in self._fs.listStatus(self._path(self.folder))}

    def _made(self, name: str) -> bool:
        return made_first(self._jvm, self._fs, f"{self.folder}/{name}")

    def claimed(self, lease_s: float) -> int | None:
        """The number of a claim that is now the caller's; None while another one counts."""
        files = self._files()
        last = max((int(x.split("-")[1]) for x in files if x.startswith("claim-")), default=0)
        if last and f"free-{last}" not in files and time.time() - files[f"claim-{last}"] / 1000 < lease_s:
            return None
        return last + 1 if self._made(f"claim-{last + 1}") else None

    def free(self, claim: int) -> None:
        self._made(f"free-{claim}")

    def done(self) -> dict[int, str]:
        """The statements that were run, by place, and their checksums."""
        return {int(x.split("-")[1]): x.split("-")[2] for x in self._files() if x.startswith("done-")}

    def mark(self, place: int, checksum: str) -> None:
        self._made(f"done-{place}-{checksum}")


def _checksum(statement: str) -> str:
    return hashlib.sha256(statement.encode()).hexdigest()[:16]


def migrate(spark: SparkSession, database: str, migrations: list[Migration] = [INITIAL], lease_s: float = 600, wait_s: float = 60) -> list[int]:  # noqa: B006
    """Applies what isn't applied yet, in the order of versions, and returns those versions. A changed applied one is an error.

    Of several starters one applies a migration and the others wait, up to ``wait_s`` seconds. After
    a failure the next start goes on with the statement that failed; where a starter has died, with the one
    after the last that it had noted, which may run a second time, once its claim is ``lease_s`` seconds old.
    """
    name = f"`{database.replace('`', '``')}`"
    table = f"{name}.`{APPLIED}`"
    # of its own, so that the caller's current database stays
    own = spark.newSession()
    try:
        own.sql(f"CREATE TABLE IF NOT EXISTS {table} (version BIGINT, name STRING, checksum STRING) USING parquet")
        own.catalog.setCurrentDatabase(name)
        return [m.version for m in sorted(migrations, key=lambda m: m.version) if _apply(own, database, table, m, lease_s, wait_s)]
    except (AnalysisException, ParseException) as e:
        raise MigrationError(str(e).splitlines()[0]) from e


def _is_applied(spark: SparkSession, table: str, m: Migration) -> bool:
    spark.catalog.refreshTable(table)
    found = spark.table(table).where(F.col("version") == m.version).select("checksum").first()
    if found is not None and found[0] != m.checksum():
        raise MigrationError(f"migration {m.version} was changed after it was applied")
    return found is not None


def _apply(spark: SparkSession, database: str, table: str, m: Migration, lease_s: float, wait_s: float) -> bool:
    """Whether this starter has applied the migration; it may have been before, or another one was first."""
    if _is_applied(spark, table, m):
        return False
    journal, until = _Journal(spark, database, m.version), time.monotonic() + wait_s
    while (claim := journal.claimed(lease_s)) is None:
        if time.monotonic() > until:
            raise MigrationError(f"migration {m.version} is being applied elsewhere, for {wait_s} s and more")
        time.sleep(0.1)
        if _is_applied(spark, table, m):
            return False
    try:
        # the one before may have ended between the look at the table and the claim
        if _is_applied(spark, table, m):
            return False
        done = journal.done()
        for k, statement in enumerate(m.statements()):
            if k in done:
                if done[k] != _checksum(statement):
                    raise MigrationError(f"migration {m.version} was changed after a part of it was applied")
                continue
            spark.sql(statement.rstrip(";"))
            journal.mark(k, _checksum(statement))
        row = spark.range(1).select(F.lit(m.version).cast("bigint").alias("version"), F.lit(m.name).alias("name"), F.lit(m.checksum()).alias("checksum"))
        row.write.insertInto(table)
        return True
    finally:
        journal.free(claim)
