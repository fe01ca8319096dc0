"""Records and settings from and to JSON, as strict as a typed client expects.

``from_json`` fills in nulls and converts types where a field is missing or wrong,
so bodies are parsed as variants and their types compared.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CodecError
from ..schema import RECORD, normal_id

_VARIANT = {"string": "STRING", "bigint": "BIGINT", "boolean": "BOOLEAN"}


def encoded(schema: T.StructType = RECORD) -> Column:
    """A row as a JSON object, fields in the order of the schema."""
    return F.to_json(F.struct(*schema.fieldNames()))


def encoded_list(rows: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """All rows as one JSON array, ordered; for the edge, where a client asked for all."""
    one = F.struct(*schema.fieldNames())
    return rows.agg(F.to_json(F.sort_array(F.collect_list(one))).alias("body"))


def encoded_pages(rows: DataFrame, schema: T.StructType = RECORD, key: str = "id", digits: int = 2) -> DataFrame:
    """page, n and body: a JSON array, ordered, of the rows whose keys begin with the same ``digits`` characters.

    The pages in their order hold all rows in the order of keys; more digits make smaller pages of a larger table.
    """
    one = F.struct(*schema.fieldNames())
    pages = rows.groupBy(F.substring(key, 1, digits).alias("page")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(one)).alias("rows"))
    return pages.select("page", "n", F.to_json("rows").alias("body"))


def decoded(bodies: DataFrame, body: str = "body", schema: T.StructType = RECORD, key: str | None = "id") -> DataFrame:
    """The input columns, the schema's fields, and ``error``: null, or what is wrong with the body (the fields are null then).

    A body must be an object without repeated keys that has all fields with their
    types; other fields are ignored. Whole numbers have 64 bits. Ids may be written in
    upper case, in braces, without hyphens or as a URN, and are brought to one form.
    """
    # values that a generator makes are computed once: no filter or projection above repeats them
    rows = bodies.select("*", F.explode(F.array(F.try_parse_json(body))).alias("__v"))
    error =F.when(F.col("__v").isNull(), "not JSON").when(~F.schema_of_variant("__v").startswith("OBJECT"), "not an object")
    for f in schema.fields:
        kind = F.schema_of_variant(F.try_variant_get("__v", f"$.{f.name}", "variant"))
        error = error.when(F.coalesce(kind, F.lit("VOID")) != _VARIANT[f.dataType.simpleString()], f"{f.name}: missing or of another type")
        if f.dataType == T.LongType():
            error = error.when(F.try_variant_get("__v", f"$.{f.name}", "bigint") < 0, f"{f.name}: negative")
    if key:
        error = error.when(normal_id(F.try_variant_get("__v", f"$.{key}", "string")).isNull(), f"{key}: not an id")
    rows = rows.drop("error").select("*", F.explode(F.array(error)).alias("error"))
    values = []
    for f in schema.fields:
        value = F.try_variant_get("__v", f"$.{f.name}", f.dataType.simpleString())
        values.append(F.when(F.col("error").isNull(), normal_id(value) if f.name == key else value).alias(f.name))
    keep = [c for c in bodies.columns if c not in schema.fieldNames() and c != "error"]
    return rows.select(*keep, *values, "error")


def _pairs(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise CodecError("a key is repeated")
    return out


def decode_one(body: str | bytes, schema: T.StructType = RECORD, key: str | None = "id") -> dict:
    """A single body, on the driver, by the same rules."""
    from .ids import parsed_id

    def refuse(x):
        raise CodecError(f"not JSON: {x}")

    try:
        value = json.loads(body, object_pairs_hook=_pairs, parse_constant=refuse)
    except (ValueError, TypeError):
        raise CodecError("not JSON") from None
    if not isinstance(value, dict):
        raise CodecError("not an object")
    want = {T.StringType(): str, T.LongType(): int, T.BooleanType(): bool}
    out = {}
    for f in schema.fields:
        if type(value.get(f.name)) is not want[f.dataType] or (want[f.dataType] is int and not 0 <= value[f.name] < 1 << 63):
            raise CodecError(f"{f.name}: missing or of another type")
        out[f.name] = value[f.name]
    if key:
        try:
            out[key] = parsed_id(out[key])
        except Exception as e:
            raise CodecError(f"{key}: {e}") from None
    return out


def encode_one(record: dict, schema: T.StructType = RECORD) -> str:
    return json.dumps({c: record[c] for c in schema.fieldNames()}, ensure_ascii=False, separators=(",", ":"))
