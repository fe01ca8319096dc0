"""What every store of a keyed table can do, whatever holds the rows."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Row

from ..schema import KeyedTable


@runtime_checkable
class Store(Protocol):
    """A keyed table, a record at a time or in batches.

    Failures are errors of ``rollcall.errors``: NotFound for a key without a record,
    ConstraintViolation for a record or batch that breaks a rule, WriteConflict where
    another writer was first, StoreError for all else. A batch is stored whole or not
    at all. Updating or deleting a key that isn't stored changes nothing.
    """

    table: KeyedTable

    def create(self) -> None:
        """An empty table; an existing one is an error."""

    def drop(self) -> None:
        """Removes the table."""

    def server_version(self) -> str:
        """Of what holds the rows."""

    def get(self, key: str) -> Row: ...

    def get_all(self, where: Column | None = None) -> DataFrame:
        """All records, or those that a condition holds for, which reaches the scan. The schema is the table's, marks of required values included."""

    def page(self, after: str | None = None, limit: int = 100) -> tuple[list[Row], str | None]:
        """At most ``limit`` records, and the cursor after which the next page begins; None after the last. All pages hold each record once."""

    def insert(self, record: dict | Row) -> Row:
        """Returns the record as stored."""

    def update(self, record: dict | Row) -> dict | Row:
        """Returns its input."""

    def delete(self, record: dict | Row) -> None: ...

    def insert_many(self, batch: DataFrame) -> int:
        """How many records were stored."""

    def update_many(self, changes: DataFrame) -> int:
        """How many records were stored under the keys."""

    def delete_many(self, keys: DataFrame) -> int:
        """How many records were stored under the keys."""


def values_of(table: KeyedTable, record: dict | Row) -> dict:
    """The table's columns of a record; those that it lacks are null."""
    given = record.asDict() if isinstance(record, Row) else record
    return {c: given.get(c) for c in table.columns}


def rows_of(table: KeyedTable, records: Iterable[dict | Row]) -> list[tuple]:
    return [tuple(values_of(table, r).values()) for r in records]
