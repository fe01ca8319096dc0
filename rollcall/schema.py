"""Record schemas, and the rules that a keyed table holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("hash", T.StringType(), False)])

PASSWORD_CONFIG = T.StructType(
    [T.StructField("length", T.LongType(), False)] + [T.StructField(x, T.BooleanType(), False) for x in ("numbers", "lowercase", "uppercase", "symbols", "spaces", "exclude", "strict")]
)

ID_PATTERN = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"


@dataclass(frozen=True)
class KeyedTable:
    """A table with a primary key and columns whose values must be unique."""

    name: str
    schema: T.StructType
    key: str
    unique: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def others(self) -> list[str]:
        return [c for c in self.columns if c != self.key]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    def select(self, df: DataFrame) -> DataFrame:
        """The table's columns with its types; columns of other names are left out."""
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def enforced(self, df: DataFrame) -> DataFrame:
        """The columns that must have values, as such that have: a file or driver gives the mark up, and a null in one is an error when it is read.

        Filters go before it: a source doesn't take one on a column that is checked.
        """

        def checked(c: str) -> Column:
            kind = self.schema[c].dataType
            missing = F.raise_error(F.lit(f"{self.name}: {c} has no value")).cast(kind)
            # the last value is never reached, and says that there is no null
            never = F.lit("").cast(kind) if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
            return F.coalesce(F.when(F.col(c).isNull(), missing).otherwise(F.col(c)), never)

        return df.withColumns({c: checked(c) for c in self.required if df.schema[c].nullable})

    def complete(self) -> Column:
        """Whether a row has all required values."""
        out = F.lit(True)
        for c in self.required:
            out = out & F.col(c).isNotNull()
        return out


GUESTS = KeyedTable("guests", RECORD, "id", ("name",))


def normal_id(column: Column) -> Column:
    """The canonical form of an id, lower case with hyphens, from any form that ``ids.parsed_id`` takes; null if it isn't one."""
    digits = F.replace(F.replace(column, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.lower(F.replace(F.regexp_replace(digits, r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit("")))
    parts = F.regexp_replace(digits, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})\\z", "$1-$2-$3-$4-$5")
    # most ids are in that form already
    return F.when(column.rlike(ID_PATTERN), column).otherwise(F.regexp_substr(parts, F.lit(ID_PATTERN)))
