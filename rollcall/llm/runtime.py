"""Where intermediate tables go, and how they are read again."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}
#: Paths that scratch() gave out and discard() didn't take back.
_made: list[str] = []
#: Bytes of a table that is sent whole to every executor, at most.
BROADCAST_BYTES = 64 << 20
#: Bytes of rows in a range of ``in_order``, about.
PART_BYTES = 16 << 20
#: Spark's setting for the shuffle files of a query: whether they go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary folder of its own and a cluster a folder beside its tables.
    """
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local-") and spark.sparkContext.master.startswith("local"):
        key = spark.sparkContext.applicationId
        if key not in _own:
            path = tempfile.mkdtemp(prefix="rollcall-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _own[key] = f"file://{path}"
        return _own[key]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What the queries inside shuffle is removed as each of them ends; else it stays until the driver happens to collect its garbage, which may be never."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and lost executors lose nothing. The path is added to ``paths``."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if paths is not None:
        paths.append(path)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes scratch tables; nothing that reads them may be run afterwards."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made:
            _made.remove(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the scratch tables that are made inside, but for those whose paths are put into the list."""
    before, keep = len(_made), []
    try:
        yield keep
    finally:
        discard(spark, [p for p in _made[before:] if p not in keep])


def clear_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this process, once the results that read them are stored elsewhere."""
    discard(spark, list(_made))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` after which the worker gives back what it has freed, as it may stay idle while others need the memory."""

    def run_and_trim(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # the C library's own, where it has such a function
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run_and_trim


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


# names: Spark takes "Shard" and "shard" as one, so a result's names push out any column that reads alike


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(columns: Iterable[str], *names: str) -> list[str]:
    """The columns that none of the names pushes out."""
    taken = {x.lower() for x in names}
    return [c for c in columns if c.lower() not in taken]


def row_of(df: DataFrame, *without: str) -> Column:
    """All columns in one struct, ``__row``, where no name can clash with another; ``__row.*`` takes them out again."""
    return F.struct(*[F.col(quoted(c)) for c in others(df.columns, *without)]).alias("__row")


def row_columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns that ``row_of`` put away."""
    return [F.col(f"__row.{quoted(c)}") for c in others(df.columns, *without)]


def schema_with(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of ``textbytes.with_columns``."""
    keep = set(others(df.columns, *[x.name for x in fields]))
    return T.StructType([x for x in df.schema.fields if x.name in keep] + fields)


# order


def in_order(df: DataFrame, n_bytes: int, *keys: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows in ranges of the keys, sorted; as many ranges as their bytes ask for, so a task's share doesn't grow with the table.

    Ranges are drawn by rows: keys that go with the size of rows make ranges of unequal bytes.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-int(n_bytes) // part_bytes))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def sortable(*columns: np.ndarray) -> np.ndarray:
    """One value for each row of longs, which compares as the row does."""
    flip = np.uint64(1 << 63)
    rows = np.stack([c.astype(np.int64).view(np.uint64) ^ flip for c in columns], axis=1)
    return rows.astype(">u8").view(f"S{8 * len(columns)}").ravel()


def in_byte_order(df: DataFrame, n_rows: int, size: Column, *keys: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows in ranges of the keys, sorted; the k-th partition is the k-th range, and holds rows of ``part_bytes`` and one row more at most.

    Keys are longs without nulls. They alone are sorted first, with the sizes, and the key
    at which each range begins is sent to all tasks: 8 bytes for each key of each range.
    """
    names = [f"k{i}" for i in range(len(keys))]

    def begins(batches):
        total, reached = 0, -1
        for batch in batches:
            sizes = batch.column(len(names)).to_numpy()
            if not len(sizes):
                continue
            before = total + np.cumsum(sizes) - sizes
            nth = before // part_bytes
            at = pa.array(np.flatnonzero(np.diff(nth, prepend=reached) > 0))
            total, reached = int(before[-1] + sizes[-1]), int(nth[-1])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(len(names))], names=names)

    slim = df.select(*[F.col(k).cast("long").alias(x) for k, x in zip(keys, names)], size.cast("long").alias("size"))
    found = in_order(slim, n_rows * 8 * (len(keys) + 1), *names, part_bytes=part_bytes).mapInArrow(lean(begins), ", ".join(f"{x} long" for x in names)).toArrow()
    starts = np.sort(sortable(*[found[x].to_numpy() for x in names]))
    table = df.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def range_of(*columns: pd.Series) -> pd.Series:
        own = sortable(*[c.to_numpy() for c in columns])
        return pd.Series(np.maximum(np.searchsorted(table.value, own, side="right") - 1, 0))

    dealt = df.withColumn("__range", range_of(*keys)).repartitionById(max(1, len(starts)), "__range")
    return dealt.sortWithinPartitions(*keys).drop("__range")


def sent_whole(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """Broadcast if the rows are known to be few enough; otherwise joined as any table."""
    return F.broadcast(df) if n_rows * row_bytes <= BROADCAST_BYTES else df


def numbered(df: DataFrame, name: str, *order: Column | str, keep: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """``df``, or the columns to keep, with ``nth``, a row's number in the order from 0 without gaps; written under the name.

    Rows are sorted in ranges and numbered inside of each; one row for each range passes through one task.
    """
    keep = keep or df.columns
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = rows.select(*keep, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    rows = written(rows, name, paths)
    past = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__part"), F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__base"))
    # 12 bytes for each range
    return rows.join(F.broadcast(base), "__part").select(*keep, (F.col("__base") + F.col("__at")).alias("nth"))


def summed_before(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with a column for each of ``sums`` (new name to column): its sum over the rows before.

    Ranges are summed side by side; only one row for each range passes through one task.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), name)
    past = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    base = base.select("__part", *[F.coalesce(F.sum(f"__{new}").over(past), F.lit(0)).alias(f"__{new}") for new in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{new}") for new, c in sums.items()])
    rows = rows.join(sent_whole(base, parts, 8 + 8 * len(sums)), "__part")
    return rows.select(*df.columns, *[(F.col(f"__{new}") + F.col(f"__in_{new}")).alias(new) for new in sums])
