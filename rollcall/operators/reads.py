"""Point lookup and full scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import NotFound, StoreError
from ..schema import KeyedTable


def scan(table: KeyedTable, stored: DataFrame) -> DataFrame:
    """All records, in no order; lazy. Columns that must have values are marked so, and a missing one is an error when it is read."""
    return table.select(table.enforced(stored))


def lookup(table: KeyedTable, stored: DataFrame, key: str) -> DataFrame:
    """The record of a key, as a DataFrame of at most one row. The predicate reaches the scan."""
    return scan(table, stored.where(F.col(table.key) == F.lit(key)))


def lookup_one(table: KeyedTable, stored: DataFrame, key: str) -> Row:
    """The record of a key; none is an error, and so is more than one."""
    rows = lookup(table, stored, key).limit(2).collect()
    if not rows:
        raise NotFound(f"{table.name}: no record has the key {key}")
    if len(rows) > 1:
        raise StoreError(f"{table.name}: more than one record has the key {key}")
    return rows[0]
