"""Tables that are settled between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def _folder(df: DataFrame) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in a local session, one beside the tables on a cluster."""
    spark = df.sparkSession
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-"):
        if context.applicationId not in _own:
            path = tempfile.mkdtemp(prefix="rollcall-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _own[context.applicationId] = f"file://{path}"
        return _own[context.applicationId]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def settled(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """The rows, computed once, written and read again; no lineage is left that a lost executor would have to repeat. The path is added to ``paths``."""
    path = f"{_folder(df)}/settled-{uuid.uuid4().hex}"
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes settled tables, and empties the list; nothing that reads them may be run afterwards."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()
