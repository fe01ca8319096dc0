"""Insert, update and delete as functions from tables to tables, and the rules that they hold.

Parquet tables know neither keys nor unique columns, so the rules are checked
here by joins and aggregations; nothing is gathered on the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation
from ..schema import KeyedTable
from ..sources.scratch import discard, settled
from .groups import connected

ORDINAL = "ordinal"
#: Rows that clash with others of their batch, and are decided in turn on the driver, at most.
IN_TURN = 100_000
#: Changes or keys of a batch that may be broadcast, at most.
FEW = 10_000


@dataclass(frozen=True)
class Inserted:
    #: the rows as stored
    accepted: DataFrame
    #: the other rows, with ``reason``: null, or the column whose value is taken
    refused: DataFrame
    #: settled tables that the two read, if any
    paths: list[str]

    def release(self) -> None:
        """Removes what was settled; to be called once nothing will read the rows any more."""
        discard(self.accepted.sparkSession, self.paths)


def _against(table: KeyedTable, rows: DataFrame, stored: DataFrame) -> DataFrame:
    """reason of each row by what is stored: null if none. Stored values grow with the table, so they are never broadcast."""
    reason = F.lit(None).cast("string")
    for c in reversed((table.key, *table.unique)):
        have = stored.select(F.col(c).alias(f"__{c}")).where(F.col(f"__{c}").isNotNull()).distinct()
        rows = rows.join(have.hint("merge"), F.col(c) == F.col(f"__{c}"), "left")
        reason = F.when(F.col(f"__{c}").isNotNull(), F.lit(c)).otherwise(reason)
    return rows.withColumn("reason", F.when(~table.complete(), F.lit("null")).otherwise(reason)).drop(*[f"__{c}" for c in (table.key, *table.unique)])


def _reasons(table: KeyedTable, rows: DataFrame, accepted: DataFrame, ordinal: str) -> DataFrame:
    """The ordinals of refused rows with the first rule that they break, by accepted rows before them or by what is stored (``reason`` so far)."""
    reason = F.lit(None).cast("string")
    for c in reversed((table.key, *table.unique)):
        have = accepted.select(F.col(c).alias(f"__{c}"), F.col(ordinal).alias(f"__by_{c}"))
        rows = rows.join(have.hint("merge"), F.col(c) == F.col(f"__{c}"), "left")
        reason = F.when((F.col("reason") == c) | (F.col(f"__by_{c}") < F.col(ordinal)), F.lit(c)).otherwise(reason)
    reason = F.when(F.col("reason") == "null", "null").otherwise(reason)
    return rows.select(ordinal, reason.alias("reason"))


def _in_turn(rows: Iterable[tuple], n_rules: int, rules: tuple[str, ...]) -> Iterator[tuple[int, str]]:
    """ordinal and reason ("" if accepted) of rows in their order: values of each rule, ordinal, and the reason so far."""
    taken = [set() for _ in range(n_rules)]
    for *values, ordinal, reason in rows:
        for k, c in enumerate(rules):
            if reason == c or values[k] in taken[k]:
                yield ordinal, c
                break
        else:
            for k in range(n_rules):
                taken[k].add(values[k])
            yield ordinal, ""


def _decided_in_groups(table: KeyedTable, contested: DataFrame, ordinal: str, paths: list[str]) -> DataFrame:
    """The same for any number of rows: connected groups of clashing rows are decided side by side.

    A row that is the first of its group by every rule is accepted, and what clashes with it
    refused; a value that very many rows share is decided by that. What is left, rows whose
    forerunners are undecided themselves, is labelled by connected group and passes, in order, by the
    task of its group, which holds the values taken in it. Clashing rows grow with the batch, so none of the joins broadcasts.
    """
    rules, spark, own = (table.key, *table.unique), contested.sparkSession, []
    rows = settled(contested, own)
    open_ = rows.where("reason IS NULL")
    first = F.lit(True)
    for c in rules:
        least = rows.where("reason IS NULL").groupBy(F.col(c).alias(f"__{c}")).agg(F.min(ordinal).alias(f"__by_{c}"))
        open_ = open_.join(least.hint("merge"), F.col(c) == F.col(f"__{c}"))
        first = first & (F.col(ordinal) == F.col(f"__by_{c}"))
    open_ = settled(open_.select(*rules, ordinal, first.alias("first")), own)
    accepted, left = open_.where("first"), open_.where("NOT first")
    for c in rules:
        left = left.join(accepted.select(F.col(c).alias(f"__{c}")).hint("merge"), F.col(c) == F.col(f"__{c}"), "left_anti")
    left = settled(left.select(*rules, ordinal), own)
    edges = None
    for c in rules:
        least = left.groupBy(F.col(c).alias(f"__{c}")).agg(F.min(ordinal).alias("v"))
        more = left.join(least.hint("merge"), F.col(c) == F.col(f"__{c}")).select(F.col(ordinal).alias("u"), "v")
        edges = more if edges is None else edges.unionAll(more)
    roots = connected(edges, own)
    labelled = left.join(roots.hint("merge"), F.col(ordinal) == F.col("node"), "left").select(F.coalesce("root", ordinal).alias("root"), *rules, ordinal)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                yield from zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)])

        for _, group in itertools.groupby(each(), key=lambda r: r[0]):
            done = [o for o, reason in _in_turn(((*r[1:], None) for r in group), len(rules), rules) if not reason]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=[ordinal])

    later = labelled.repartition("root").sortWithinPartitions("root", ordinal).mapInArrow(decide, f"`{ordinal}` long")
    later = left.join(later.hint("merge"), ordinal, "left_semi")
    accepted = settled(accepted.select(*rules, ordinal).unionByName(later.select(*rules, ordinal)), own)
    refused = rows.join(accepted.select(ordinal).hint("merge"), ordinal, "left_anti")
    out = _reasons(table, refused, accepted, ordinal).select(ordinal, F.col("reason").alias("verdict"))
    out = settled(out.unionAll(accepted.select(ordinal, F.lit("").alias("verdict"))), paths)
    discard(spark, own)
    return out


def insert(table: KeyedTable, stored: DataFrame, batch: DataFrame, ordinal: str = ORDINAL) -> Inserted:
    """What a row-by-row insert in the order of ``ordinal`` would store and refuse.

    A refused row reserves nothing. Rows that clash with no other row of the batch are decided by joins alone.
    Of the others, up to ``IN_TURN`` are decided in turn on the driver, in one job however they
    clash; more than that in connected groups, side by side. Ordinals must differ, and the batch
    has to give the same rows whenever it is computed (the stores settle it first).
    """
    rules, columns = (table.key, *table.unique), [*table.columns, ordinal]
    typed = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields], F.col(ordinal).cast("long").alias(ordinal))
    rows, contested = typed, F.lit(False)
    for c in rules:
        # values that several rows of the batch have; each task counts its own before they meet
        shared = typed.where(table.complete()).groupBy(F.col(c).alias(f"__{c}")).agg(F.count(F.lit(1)).alias(f"__n_{c}")).where(f"__n_{c} > 1")
        rows = rows.join(shared.hint("merge"), F.col(c) == F.col(f"__{c}"), "left")
        contested = contested | F.col(f"__n_{c}").isNotNull()
    rows = rows.select(*columns, (contested & table.complete()).alias("contested"))
    rows = _against(table, rows, stored).select(*columns, "reason", "contested")
    clashing = rows.where("contested").select(*rules, ordinal, "reason")
    found, paths = clashing.limit(IN_TURN + 1).toArrow(), []
    if not found.num_rows:
        verdicts = None
    elif found.num_rows <= IN_TURN:
        in_order = found.sort_by(ordinal).to_pydict()
        decided = list(_in_turn(zip(*in_order.values()), len(rules), rules))
        verdicts = batch.sparkSession.createDataFrame(pa.table({ordinal: pa.array([d[0] for d in decided], pa.int64()), "verdict": pa.array([d[1] for d in decided], pa.string())}))
    else:
        verdicts = _decided_in_groups(table, clashing, ordinal, paths).hint("merge")
    if verdicts is not None:
        rows = rows.join(verdicts, ordinal, "left").withColumn("reason", F.when(F.col("contested"), F.nullif("verdict", F.lit(""))).otherwise(F.col("reason")))
    return Inserted(table.select(rows.where("reason IS NULL")), rows.where("reason IS NOT NULL").select(*columns, "reason"), paths)


def insert_state(table: KeyedTable, stored: DataFrame, inserted: Inserted) -> DataFrame:
    """The table after the insert."""
    return table.select(stored).unionByName(inserted.accepted)


def insert_all(table: KeyedTable, stored: DataFrame, batch: DataFrame, ordinal: str = ORDINAL) -> Inserted:
    """As ``insert``, but a refused row is an error."""
    out = insert(table, stored, batch, ordinal)
    bad = out.refused.orderBy(ordinal).select("reason", ordinal).first()
    if bad is not None:
        raise ConstraintViolation(f"{table.name}: row {bad[ordinal]} breaks the rule on {'required values' if bad['reason'] == 'null' else bad['reason']}")
    return out


def check_new(table: KeyedTable, stored: DataFrame, one: DataFrame) -> None:
    """Whether a single row may be stored: its values are looked up in the table by predicates that reach the scan."""
    row = one.select(*table.columns).first()
    if any(row[c] is None for c in table.required):
        raise ConstraintViolation(f"{table.name}: the row breaks the rule on required values")
    rules = (table.key, *table.unique)
    meets = F.lit(False)
    for c in rules:
        meets = meets | (F.col(c) == F.lit(row[c]))
    taken = stored.where(meets).select(*rules).limit(len(rules)).collect()
    for c in rules:
        if any(r[c] == row[c] for r in taken):
            raise ConstraintViolation(f"{table.name}: the row breaks the rule on {c}")


def _batch(rows: DataFrame, few: bool) -> DataFrame:
    """The batch's side of a join with what is stored. It may grow with the table, and Spark's estimate of it may be far too low, so it merges unless it is known to be small."""
    return rows if few else rows.hint("merge")


def update(table: KeyedTable, stored: DataFrame, changes: DataFrame, few: bool = False) -> DataFrame:
    """The table after the update; keys that aren't stored change nothing. One change for each key.

    ``few``: whether there are at most ``FEW`` changes, so that Spark may broadcast them.
    """
    new = table.select(changes).select(F.col(table.key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in table.others])
    rows = table.select(stored).join(_batch(new, few), F.col(table.key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    return rows.select(*[F.col(c) if c == table.key else F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in table.columns])


def update_echo(table: KeyedTable, changes: DataFrame) -> DataFrame:
    """What an update returns: the changes, whether or not their keys are stored."""
    return table.select(changes)


def delete(table: KeyedTable, stored: DataFrame, keys: DataFrame, few: bool = False) -> DataFrame:
    """The table without the records of the keys; other columns of ``keys`` don't matter, nor do keys that aren't stored. ``few`` as for ``update``."""
    return table.select(stored).join(_batch(keys.select(table.key).distinct(), few), table.key, "left_anti").select(*table.columns)


def affected(table: KeyedTable, stored: DataFrame, keys: DataFrame) -> int:
    """How many stored records an update or delete by these keys concerns."""
    return stored.join(_batch(keys.select(table.key).distinct(), few=False), table.key, "left_semi").count()


def violations(table: KeyedTable, rows: DataFrame) -> DataFrame:
    """rule, value and n: what breaks the table's rules."""
    out = rows.where(~table.complete()).select(F.lit("null").alias("rule"), F.col(table.key).alias("value"), F.lit(1).cast("long").alias("n"))
    for c in (table.key, *table.unique):
        twice = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionAll(twice.select(F.lit(c).alias("rule"), F.col(c).alias("value"), "n"))
    return out


def check(table: KeyedTable, rows: DataFrame) -> None:
    bad = violations(table, rows).first()
    if bad is not None:
        raise ConstraintViolation(f"{table.name}: the rule on {'required values' if bad['rule'] == 'null' else bad['rule']} is broken by {bad['value']!r}")
