"""A keyed table in versioned Parquet snapshots.

Rows lie in buckets by a hash of their key, and a version is a list of folders, each of one
bucket. An insert adds folders of the new rows alone and lists the old ones again. An
update or delete reads the buckets of its keys, writes those that hold one of them anew, and lists
the others again; so does an insert for a bucket that would have more than ``MAX_FOLDERS``
folders. Files are sorted by key and have Bloom filters of the key and the unique columns, so a lookup
by a value reads the row groups that may hold it.

The number after the version that was read is claimed by creating its claim file, which only one writer can, then
the rows are written, then the list, then the version is committed by another file. Readers take the highest committed version and keep
reading it while others write. A writer that comes second waits for the first, checks its rows against what was added since, and
goes on from there. Files are made through Hadoop's file systems, so any shared store that can create a file
exclusively will do. Folders that no version lists any more stay for readers of old versions; ``vacuum`` removes them.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, RequestError, StoreError, WriteConflict
from ..operators import reads, writes
from ..schema import GUESTS, KeyedTable
from .files import made_first
from .scratch import discard, settled
from .store import rows_of, values_of

#: Folders of a bucket that a version lists at most.
MAX_FOLDERS = 64
#: Buckets of a new table. One is the least that a changed row writes anew: about 1 GB of rows each is a good size.
BUCKETS = 16
BUCKET = "__bucket"


class SnapshotStore:
    """buckets counts when the table is created; wait_s is how long a writer waits for one that came first."""

    def __init__(self, spark: SparkSession, path: str, table: KeyedTable = GUESTS, buckets: int = BUCKETS, wait_s: float = 5):
        self.spark, self.path, self.table, self._new_buckets, self.wait_s = spark, path.rstrip("/"), table, buckets, wait_s
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[int]:
        folder = self._path(f"{self.path}/_{kind}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(folder) if x.getPath().getName().isdigit())

    def _mark(self, kind: str, n: int) -> bool:
        self._fs.mkdirs(self._path(f"{self.path}/_{kind}"))
        return made_first(self._jvm, self._fs, f"{self.path}/_{kind}/{n}")

    def _list(self, n: int, folders: list[str]) -> None:
        out = self._fs.create(self._path(f"{self.path}/_lists/{n}"), True)
        try:
            out.writeBytes("\n".join(folders))
        finally:
            out.close()

    def folders(self, version: int, buckets: Iterable[int] | None = None) -> list[str]:
        """The folders that a version lists, or those of some buckets."""
        stream = self._fs.open(self._path(f"{self.path}/_lists/{version}"))
        try:
            found = [x for x in self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n") if x]
        finally:
            stream.close()
        if buckets is None:
            return found
        wanted = set(buckets)
        return [x for x in found if self._bucket_of(x) in wanted]

    @staticmethod
    def _bucket_of(folder: str) -> int:
        return int(folder.rsplit("=", 1)[1])

    @property
    def buckets(self) -> int:
        return max(self._marks("buckets"), default=self._new_buckets)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of keys; there are no more of them than the table has."""
        return [r[0] for r in keys.where(F.col(self.table.key).isNotNull()).select(self._bucket(F.col(self.table.key))).distinct().collect()]

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self._marks("commits"), default=0)

    def create(self) -> None:
        """An empty table; an existing one is an error."""
        if self.version():
            raise StoreError(f"{self.path} holds a table already")
        self._mark("buckets", self._new_buckets)
        self.replace(self.spark.createDataFrame([], self.table.schema), 0)

    def drop(self) -> None:
        """Removes the table, if there is one."""
        self._fs.delete(self._path(self.path), True)

    def _give_up(self, n: int) -> None:
        for where in (f"v{n}", f"_lists/{n}", f"_claims/{n}"):
            self._fs.delete(self._path(f"{self.path}/{where}"), True)

    def recover(self) -> list[int]:
        """Gives up versions that were claimed but never committed; call it when no writer is at work."""
        stale = sorted(set(self._marks("claims")) - set(self._marks("commits")))
        for n in stale:
            self._give_up(n)
        return stale

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, or those of some buckets. Parquet gives up not-null marks; ``get_all`` puts them back."""
        n = self.version() if version is None else version
        if not n:
            raise StoreError(f"{self.path} holds no table")
        return self._rows_in(self.folders(n, buckets))

    def _rows_in(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.table.schema)
        return self.spark.read.schema(self.table.schema).parquet(*[f"{self.path}/{x}" for x in folders])

    def replace(self, rows: DataFrame, base: int) -> int:
        """Commits rows as the version after ``base``; another writer that was first is an error."""
        return self._commit(rows, base, [])

    def append(self, rows: DataFrame, base: int) -> int:
        """Commits the rows of ``base`` and these besides; only these are written."""
        return self._commit(rows, base, self.folders(base))

    def _commit(self, rows: DataFrame, base: int, kept: list[str]) -> int:
        n = base + 1
        if self.version() != base or not self._mark("claims", n):
            raise WriteConflict(f"version {n} of {self.path} is taken")
        try:
            self._write(rows, n)
            # a bucket without rows has no folder
            there = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/v{n}"))]
            self._list(n, [*kept, *sorted(f"v{n}/{x}" for x in there if x.startswith(f"{BUCKET}="))])
            self._mark("commits", n)
        except BaseException:
            self._give_up(n)
            raise
        return n

    def _write(self, rows: DataFrame, n: int) -> None:
        rows = self.table.select(rows).withColumn(BUCKET, self._bucket(F.col(self.table.key)))
        # small buckets share tasks and large ones are split, by the size of what comes
        writer = rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, self.table.key).write.partitionBy(BUCKET)
        for c in (self.table.key, *self.table.unique):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{self.path}/v{n}")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes the folders that none of the last ``keep`` versions lists, and returns their names; call it when no one reads or writes older ones."""
        commits = self._marks("commits")
        listed = {x for n in commits[-keep:] for x in self.folders(n)}
        gone = sorted({x for n in commits[:-keep] for x in self.folders(n)} - listed)
        for x in gone:
            self._fs.delete(self._path(f"{self.path}/{x}"), True)
        return gone

    def _waited(self, base: int) -> int:
        """The version that a writer who was first has committed after ``base``."""
        until = time.monotonic() + self.wait_s
        while (n := self.version()) == base:
            if time.monotonic() > until:
                raise WriteConflict(f"version {base + 1} of {self.path} is taken, and not committed in {self.wait_s} s")
            time.sleep(0.05)
        return n

    def _retried(self, change: Callable[[], int]) -> int:
        """A change that starts from the last version, done again from the next one if another writer was first."""
        until = time.monotonic() + 10 * self.wait_s
        while True:
            base = self.version()
            try:
                return change()
            except WriteConflict:
                if time.monotonic() > until:
                    raise
                self._waited(base)

    def server_version(self) -> str:
        """That of Spark, which reads and writes the files."""
        return self.spark.sql("SELECT version()").first()[0]

    # a record at a time

    def _frame(self, rows: Iterable[dict | Row]) -> DataFrame:
        schema = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in self.table.schema.fields) + ",ordinal:bigint>"
        return self.spark.createDataFrame([(*v, k) for k, v in enumerate(rows_of(self.table, rows))], schema).coalesce(1)

    def get(self, key: str) -> Row:
        key_of = self.spark.sql("SELECT :k AS k", {"k": key}).select(F.col("k").alias(self.table.key))
        return reads.lookup_one(self.table, self.read(buckets=self._buckets_of(key_of)), key)

    def get_all(self, where: Column | None = None) -> DataFrame:
        stored = self.read()
        return reads.scan(self.table, stored if where is None else stored.where(where))

    def page(self, after: str | None = None, limit: int = 100) -> tuple[list[Row], str | None]:
        """Pages go through one bucket after another, each in the order of keys: a page reads the folders of its buckets, and of those what lies after the cursor."""
        version, bucket, key = self._cursor(after)
        listed = sorted({self._bucket_of(x) for x in self.folders(version)})
        found: list[Row] = []
        for b in [b for b in listed if b >= bucket]:
            stored = self.read(version, [b])
            if b == bucket and key is not None:
                stored = stored.where(F.col(self.table.key) > F.lit(key))
            found += reads.scan(self.table, stored).orderBy(self.table.key).limit(limit + 1 - len(found)).collect()
            if len(found) > limit:
                last = found[limit - 1][self.table.key]
                own = self.spark.range(1).select(self._bucket(F.lit(last))).first()[0]
                return found[:limit], f"{version}.{own}.{last}"
        return found, None

    def _cursor(self, after: str | None) -> tuple[int, int, str | None]:
        """version, bucket and key. A cursor keeps to the version of the first page, while that isn't removed."""
        if after is None:
            return self.version(), 0, None
        version, _, rest = after.partition(".")
        bucket, _, key = rest.partition(".")
        if not (version.isdecimal() and bucket.isdecimal() and key) or not 0 < int(version) <= self.version():
            raise RequestError(f"not a cursor: {after!r}")
        return int(version), int(bucket), key

    def insert(self, record: dict | Row) -> Row:
        """Stores a record and returns it as stored."""
        one = self._frame([record])
        self._add(one, lambda stored: writes.check_new(self.table, stored, one))
        return self.get(values_of(self.table, record)[self.table.key])

    def update(self, record: dict | Row) -> dict | Row:
        """Changes the record of the same key, if there is one, and returns the input."""
        self.update_many(self._frame([record]))
        return record

    def delete(self, record: dict | Row) -> None:
        """Removes the record of the same key, if there is one; only the key counts."""
        self.delete_many(self._frame([record]))

    # batches

    def _add(self, rows: DataFrame, check: Callable[[DataFrame], None]) -> None:
        """Appends rows that hold the rules beside the stored ones; ``check`` refuses them if they don't.

        They are checked against the whole table once. If another writer was first, they are checked
        against the folders that it has added, and appended to those.
        """
        base = self.version()
        check(self.read(base))
        while True:
            try:
                return self._append(rows, base)
            except WriteConflict:
                before, base = set(self.folders(base)), self._waited(base)
                check(self._rows_in([x for x in self.folders(base) if x not in before]))

    def _append(self, rows: DataFrame, base: int) -> None:
        listed = self.folders(base)
        full = [b for b, n in Counter(map(self._bucket_of, listed)).items() if n >= MAX_FOLDERS]
        if not full:
            self.append(rows, base)
        else:
            own = self.table.select(self.read(base, full)).unionByName(self.table.select(rows))
            self._commit(own, base, [x for x in listed if self._bucket_of(x) not in full])

    def insert_many(self, batch: DataFrame) -> int:
        """Stores all rows of the batch or none, and returns their number; any clash is an error."""
        paths: list[str] = []
        # an ordinal of its own: which of two rows that clash came first doesn't matter, as neither is stored
        rows = settled(self.table.select(batch).selectExpr("*", "monotonically_increasing_id() AS ordinal"), paths)

        def check(stored: DataFrame) -> None:
            writes.insert_all(self.table, stored, rows).release()

        try:
            self._add(rows, check)
            return rows.count()
        finally:
            discard(self.spark, paths)

    def update_many(self, changes: DataFrame) -> int:
        """Returns how many records were stored under the keys. The table that results has to hold all rules."""
        paths: list[str] = []
        changes = settled(self.table.select(changes), paths)
        if changes.groupBy(self.table.key).count().where("count > 1").limit(1).count():
            discard(self.spark, paths)
            raise StoreError("a batch of updates has one row for each key")
        try:
            return self._retried(lambda: self._change(changes, lambda rows, hit, few: writes.update(self.table, rows, hit, few), self._check_update))
        finally:
            discard(self.spark, paths)

    def _check_update(self, base: int, hit: DataFrame) -> None:
        """Whether changes of stored records keep the rules: by themselves, and against the records that they don't touch."""
        writes.check(self.table, hit)
        for c in self.table.unique:
            others = self.read(base).select(self.table.key, c).join(hit.select(self.table.key), self.table.key, "left_anti")
            clash = hit.select(c).join(others.select(c), c, "left_semi").first()
            if clash is not None:
                raise ConstraintViolation(f"{self.table.name}: the rule on {c} is broken by {clash[0]!r}")

    def delete_many(self, keys: DataFrame) -> int:
        paths: list[str] = []
        keys = settled(keys.select(F.col(self.table.key).cast(self.table.schema[self.table.key].dataType).alias(self.table.key)).distinct(), paths)
        try:
            return self._retried(lambda: self._change(keys, lambda rows, hit, few: writes.delete(self.table, rows, hit, few)))
        finally:
            discard(self.spark, paths)

    def _change(self, keys: DataFrame, change: Callable[[DataFrame, DataFrame, bool], DataFrame], check: Callable[[int, DataFrame], None] | None = None) -> int:
        """Writes the buckets anew that hold one of the keys. Returns how many do."""
        base = self.version()
        near = self.read(base, self._buckets_of(keys))
        hit = keys.join(near.select(self.table.key), self.table.key, "left_semi")
        buckets = self._buckets_of(hit)
        count = hit.count()
        if count:
            if check:
                check(base, hit.select(*keys.columns))
            kept = [x for x in self.folders(base) if self._bucket_of(x) not in buckets]
            self._commit(change(self.read(base, buckets), hit, count <= writes.FEW), base, kept)
        return count
