"""Shards along a Hilbert curve over several metadata dimensions.

1. Each dimension is quantised at equal-depth cut points taken over all rows.
   Texts count by the seven bytes after the prefix that all have in common.
2. The cells' places on a Hilbert curve order the rows: neighbours on the curve
   are neighbours in every dimension, so a file of a run of it has narrow bounds
   in all of them and readers can skip it. Ties are ordered by id and text.
3. Places, ids and sizes alone are sorted first, to find where ranges of ``part_bytes``
   begin. Rows are then dealt to their ranges, sorted there, and written with their range
   and place in it. The ranges' counts give the rank of each row.
4. Shard and slot follow from the rank. Shard sizes differ by one row at most (law
   ``rows``). Files are written shard by shard.

A range holds ``part_bytes`` of text and one row more at most, so a task's share doesn't
grow with the table, also where the length is a dimension and long texts lie side by side.
For each range four numbers are sent to all tasks, and two are counted and summed. Defined
cases: null dimension values lie in the first cell, null ids come first, a null text has
no bytes. Rows that agree in place, id and text come in the order in which they are read,
so they may be any part of the table. Of an empty table no file is written and the result
is empty. Columns named like a result column, in upper or lower case, give way; other
names don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import PART_BYTES, discard, documents, in_byte_order, others, quoted, row_of, scratch, sent_whole, written

SHARDS, LAW = 40, "rows"
DIMENSIONS = (("source", "string"), ("lang", "string"), ("n_chars", "number"))
#: Bits of each dimension.
BITS = 5
ROW_BYTES = 16


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """The place on the curve of cells of 0 .. 2 ** bits - 1 in each dimension."""
    x = [np.array(c, dtype=np.int64) for c in cells]
    # turn and mirror the sub-cubes, from the largest on
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            mirror = (x[i] & bit) != 0
            swap = np.where(mirror, 0, (x[0] ^ x[i]) & below)
            x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(mirror, below, swap)
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ flip) >> level) & 1)
    return out


def _common_prefix(a: str | None, b: str | None) -> int:
    """Bytes that two texts begin with alike."""
    x, y = (a or "").encode(), (b or "").encode()
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def _scale(docs: DataFrame, dimensions, bits: int) -> tuple[list[Column], list[np.ndarray], int]:
    """A number for each dimension, its cut points, and the rows of the table."""
    text_columns = [c for c, kind in dimensions if kind == "string"]
    ends = docs.agg(F.count(F.lit(1)), *[f(c) for c in text_columns for f in (F.min, F.max)]).first()
    numbers, k = [], 1
    for c, kind in dimensions:
        if kind == "string":
            skip = _common_prefix(ends[k], ends[k + 1])
            k += 2
            head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, 7)), 14, "0")
            numbers.append(F.conv(head, 16, 10).cast("double"))
        else:
            numbers.append(F.col(c).cast("double"))
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = docs.agg(*[F.percentile_approx(F.when(~F.isnan(x), x), at, 10_000) for x in numbers]).first()
    return numbers, [np.unique(np.array(c or [], dtype=np.float64)) for c in cuts], ends[0]


def _place(columns: list[np.ndarray], cuts: list[np.ndarray], bits: int) -> np.ndarray:
    cells = [np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="right")) for x, cut in zip(columns, cuts)]
    return hilbert_index(cells, bits)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, dimensions=DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes ``docs`` with hilbert, slot and shard to a folder of a subfolder for each shard, and reads them."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES
    numbers, cuts, n_rows = _scale(docs, dimensions, bits)
    new = [T.StructField("hilbert", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())]
    keep = others(docs.columns, *[x.name for x in new])
    schema = T.StructType([x for x in docs.schema.fields if x.name in keep] + new)
    if not n_rows:
        return spark.createDataFrame([], schema)

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        return pd.Series(_place([c.to_numpy(dtype=np.float64) for c in columns], cuts, bits))

    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(row_of(docs, *[x.name for x in new]), place(*numbers).alias("hilbert"), key.alias("id"), tie.alias("tie"), size.alias("size"), F.monotonically_increasing_id().alias("read"))
    paths: list[str] = []
    rows = in_byte_order(rows, n_rows, F.col("size"), "hilbert", "id", "tie", "read", part_bytes=part_bytes)
    # the number that Spark gives a sorted row is its range, and in the lower 33 bits its place there
    rows = written(rows.select("__row", "hilbert", F.monotonically_increasing_id().alias("at")), "ranked", paths)
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("first"))
    # 16 bytes for each range
    rows = rows.join(sent_whole(first, counts.count(), 16), part == F.col("part"))
    rows = rows.withColumn("rank", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = rows.withColumn("shard", F.expr(f"(((rank + 1) * {shards} + {n_rows - 1}) div {n_rows}) - 1").cast("int"))
    rows = rows.withColumn("slot", F.expr(f"rank - (shard * {n_rows}L) div {shards}"))
    rows = rows.select(*[F.col(f"__row.{quoted(c)}") for c in keep], "hilbert", "slot", "shard")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    discard(spark, paths)
    return spark.read.schema(schema).parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_shards(documents(spark, sf_dir), scratch(spark, "shards"))
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )
