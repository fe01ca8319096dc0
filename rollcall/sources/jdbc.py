"""A keyed table in a database that Spark reaches by JDBC and that holds the rules itself.

Batches go to a staging table first, over many connections, and from there into the
table by one statement, so the database takes all of a batch or none of it.
"""

from __future__ import annotations

import contextlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, StoreError
from ..operators import reads
from ..schema import GUESTS, KeyedTable
from .dialects import Dialect, store_error
from .pool import Pool, opened
from .store import values_of

#: Options that are for Spark's source; all others belong to the driver's connection.
SPARK_OPTIONS = frozenset(
    "url dbtable query driver numpartitions partitioncolumn lowerbound upperbound batchsize fetchsize isolationlevel sessioninitstatement truncate cascadetruncate "
    "createtableoptions createtablecolumntypes customschema pushdownpredicate pushdownaggregate pushdownlimit pushdownoffset pushdowntablesample keytab principal "
    "refreshkrb5config connectionprovider preparequery querytimeout prefertimestampntz hint".split()
)
#: First characters of keys at which a scan is split.
DIGITS = "0123456789abcdef"


class JdbcStore:
    """Reads push the key's predicate and the columns down; a full scan runs over ``partitions`` ranges of keys side by side.

    Statements of the driver take their connections from ``pool``; without one the store makes its own. Scans and
    batches are read and written by tasks, each over a connection of its own.
    """

    def __init__(self, spark: SparkSession, options: dict[str, str], table: KeyedTable = GUESTS, partitions: int | None = None, pool: Pool | None = None, dialect: Dialect | None = None):
        self.spark, self.options, self.table, self.dialect = spark, dict(options), table, dialect
        self.pool = pool or Pool(lambda: opened(spark, self.options["url"], self.connection_properties(), self.options.get("driver")))
        self.partitions = min(len(DIGITS), max(1, int(partitions if partitions is not None else self.options.get("numPartitions", 1))))

    @classmethod
    def from_connection(cls, spark: SparkSession, connection, table: KeyedTable = GUESTS, **more: str) -> JdbcStore:
        """From connection settings (``plans.config.Connection``); ``more`` are options that add to theirs."""
        return cls(spark, connection.jdbc() | more, table)

    def create(self, key_type: str = "VARCHAR(36)", text_type: str = "VARCHAR(1000)") -> None:
        self._run(f"CREATE TABLE {self.table.name} ({self._columns(key_type, text_type, True)})")

    def _columns(self, key_type: str, text_type: str, rules: bool) -> str:
        key = f"{self.table.key} {key_type}" + (" NOT NULL PRIMARY KEY" if rules else "")
        return ", ".join([key] + [f"{c} {text_type}" + (f" NOT NULL{' UNIQUE' if c in self.table.unique else ''}" if rules else "") for c in self.table.others])

    def drop(self) -> None:
        self._run(f"DROP TABLE {self.table.name}")

    def connection_properties(self) -> dict[str, str]:
        """What the driver is given on every connection, Spark's or this one's own: credentials, TLS and all else that isn't for Spark."""
        return {k: str(v) for k, v in self.options.items() if k.lower() not in SPARK_OPTIONS}

    def _run(self, sql: str, *values: str | None) -> int:
        """A statement on the driver's own connection; the values are bound."""
        return self._run_all([(sql, values)])[0]

    def _run_all(self, statements: list[tuple[str, tuple]]) -> list[int]:
        """Statements in one transaction."""
        try:
            with self.pool.connection() as connection:
                counts = []
                for sql, values in statements:
                    statement = connection.prepareStatement(sql)
                    for i, v in enumerate(values):
                        statement.setString(i + 1, v)
                    counts.append(statement.executeUpdate())
                    statement.close()
                return counts
        except Py4JJavaError as e:
            raise self._error(e) from e

    def _error(self, error: Exception) -> StoreError:
        return store_error(error, self.table.name)

    def server_version(self) -> str:
        """Name and version of the database's server."""
        try:
            with self.pool.connection() as connection:
                about = connection.getMetaData()
                return f"{about.getDatabaseProductName()} {about.getDatabaseProductVersion()}"
        except Py4JJavaError as e:
            raise self._error(e) from e

    def _ranges(self) -> list[str]:
        """Predicates that cut the keys, ids in lower or upper case or anything else, into ranges; each row meets one of them."""
        key, n = self.dialect.key_text(self.table.key) if self.dialect else self.table.key, self.partitions
        cuts = [DIGITS[len(DIGITS) * k // n] for k in range(1, n)]
        if not cuts:
            return []
        inner = [f"{key} >= '{a}' AND {key} < '{b}'" for a, b in zip(cuts, cuts[1:])]
        return [f"{key} < '{cuts[0]}'", *inner, f"{key} >= '{cuts[-1]}' OR {key} IS NULL"]

    def get_all(self, where: Column | None = None) -> DataFrame:
        read = self.spark.read
        if ranges := self._ranges():
            own = {k: str(v) for k, v in self.options.items() if k.lower() not in ("url", "dbtable", "numpartitions")}
            read = read.jdbc(self.options["url"], self.table.name, predicates=ranges, properties=own)
        else:
            read = read.format("jdbc").options(**self.options).option("dbtable", self.table.name).load()
        stored = self._named(read)
        return reads.scan(self.table, stored if where is None else stored.where(where))

    def _named(self, read: DataFrame) -> DataFrame:
        # some databases give names back in upper case
        names = {c.lower(): c for c in read.columns}
        return read.select(*[F.col(names[c.lower()]).alias(c) for c in self.table.columns])

    def get(self, key: str) -> Row:
        one = self.spark.read.format("jdbc").options(**self.options).option("dbtable", self.table.name).load()
        return reads.lookup_one(self.table, self._named(one), key)

    def page(self, after: str | None = None, limit: int = 100) -> tuple[list[Row], str | None]:
        """Pages go in the order of keys, by the index of the primary key; a cursor is the last key."""
        key, columns = self.table.key, self.table.columns
        sql = f"SELECT {', '.join(columns)} FROM {self.table.name}{f' WHERE {key} > ?' if after is not None else ''} ORDER BY {key} FETCH FIRST {int(limit) + 1} ROWS ONLY"
        try:
            with self.pool.connection() as connection:
                statement = connection.prepareStatement(sql)
                if after is not None:
                    statement.setString(1, after)
                rows, found = statement.executeQuery(), []
                while rows.next():
                    found.append(Row(**{c: rows.getString(k + 1) for k, c in enumerate(columns)}))
                statement.close()
        except Py4JJavaError as e:
            raise self._error(e) from e
        return found[:limit], found[limit - 1][key] if len(found) > limit else None

    # a record at a time

    def insert(self, record: dict | Row) -> Row:
        values = values_of(self.table, record)
        marks = ", ".join("?" * len(values))
        self._run(f"INSERT INTO {self.table.name} ({', '.join(values)}) VALUES ({marks})", *values.values())
        return self.get(values[self.table.key])

    def update(self, record: dict | Row) -> dict | Row:
        values = values_of(self.table, record)
        sets = ", ".join(f"{c} = ?" for c in self.table.others)
        self._run(f"UPDATE {self.table.name} SET {sets} WHERE {self.table.key} = ?", *[values[c] for c in self.table.others], values[self.table.key])
        return record

    def delete(self, record: dict | Row) -> None:
        self._run(f"DELETE FROM {self.table.name} WHERE {self.table.key} = ?", values_of(self.table, record)[self.table.key])

    # batches

    def _staged(self, rows: DataFrame, statements: list[str], columns: list[str]) -> list[int]:
        """Writes the columns of the rows to a staging table, runs statements that read it as {staged} in one transaction, and drops it."""
        staged = f"{self.table.name}_{uuid.uuid4().hex[:12]}"
        # the columns have the types of the table's, whatever it was made with
        self._run(f"CREATE TABLE {staged} AS SELECT {', '.join(columns)} FROM {self.table.name} WITH NO DATA")
        try:
            try:
                rows.write.format("jdbc").options(**self.options).option("dbtable", staged).mode("append").save()
            except (PySparkException, Py4JJavaError) as e:
                raise self._error(e) from e
            counts = self._run_all([(s.format(staged=staged), ()) for s in statements])
        except BaseException:
            # what failed first is what the caller hears of
            with contextlib.suppress(StoreError):
                self._run(f"DROP TABLE {staged}")
            raise
        self._run(f"DROP TABLE {staged}")
        return counts

    def _whole(self, rows: DataFrame) -> DataFrame:
        """The table's columns of the rows. A missing value is refused here: not every driver takes a null as the type that Spark gives it."""
        rows = self.table.select(rows)
        if not rows.where(~self.table.complete()).isEmpty():
            raise ConstraintViolation(f"{self.table.name}: a row breaks the rule on required values")
        return rows

    def insert_many(self, batch: DataFrame) -> int:
        """Stores all rows of the batch or none, and returns their number."""
        columns = ", ".join(self.table.columns)
        return self._staged(self._whole(batch), [f"INSERT INTO {self.table.name} ({columns}) SELECT {columns} FROM {{staged}}"], self.table.columns)[0]

    def update_many(self, changes: DataFrame) -> int:
        """Returns how many records were stored under the keys. One change for each key; all are made or none."""
        key, name = self.table.key, self.table.name
        rows = self._whole(changes)
        if rows.groupBy(key).count().where("count > 1").limit(1).count():
            raise StoreError("a batch of updates has one row for each key")
        columns = ", ".join(self.table.columns)
        stored = f"{key} IN (SELECT {key} FROM {name})"
        # in the changed rows all other columns are new, so rows can be exchanged
        return self._staged(rows, [f"DELETE FROM {{staged}} WHERE NOT {stored}", f"DELETE FROM {name} WHERE {key} IN (SELECT {key} FROM {{staged}})", f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {{staged}}"], self.table.columns)[2]

    def delete_many(self, keys: DataFrame) -> int:
        key = self.table.key
        rows = keys.select(F.col(key).cast(self.table.schema[key].dataType).alias(key)).distinct()
        return self._staged(rows, [f"DELETE FROM {self.table.name} WHERE {key} IN (SELECT {key} FROM {{staged}})"], [key])[0]
