"""The registered queries of the record registry, and the SQL that gives the same rows.

Records are derived from ``customer``: its keys and names are unique and never null.
Batches come from whole tables as well: inserts and updates from ``supplier``, deletes
from ``nation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, generate
from ..functions.generate import ADJECTIVES, NOUNS, PasswordConfig
from ..functions.ids import keyed_id
from ..operators import reads, writes
from ..schema import GUESTS
from .config import masked_dsn

#: The custom configuration: every class but upper case, strict, without similar characters.
CUSTOM = PasswordConfig(length=20, numbers=False, lowercase=False, uppercase=True, symbols=True, spaces=True, exclude=True, strict=True)
STRICT = PasswordConfig(length=12, numbers=True, lowercase=True, uppercase=True, symbols=True, spaces=False, exclude=True, strict=True)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(keyed_id(F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.md5(F.concat("c_mktsegment", F.lit(":"), "c_name")).alias("hash"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch to insert: all suppliers as new records, and again under stored ids, stored names and names of the batch."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    own = s.select(keyed_id(F.concat(F.lit("s"), F.col("k").cast("string"))).alias("id"), F.col("n").alias("name"), (4 * F.col("k")).alias("ordinal"))
    by_id = s.select(keyed_id(F.col("k")).alias("id"), F.concat(F.lit("other "), "n").alias("name"), (4 * F.col("k") + 1).alias("ordinal"))
    # suppliers grow with the table, so none of the joins broadcasts
    by_name = s.join(c.select("k", F.col("n").alias("cn")).hint("merge"), "k").select(keyed_id(F.concat(F.lit("t"), F.col("k").cast("string"))).alias("id"), F.col("cn").alias("name"), (4 * F.col("k") + 2).alias("ordinal"))
    again = s.select(keyed_id(F.concat(F.lit("u"), F.col("k").cast("string"))).alias("id"), F.col("n").alias("name"), (4 * F.col("k") + 3).alias("ordinal"))
    return own.unionByName(by_id).unionByName(by_name).unionByName(again).withColumn("hash", F.md5("name"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new name and hash for the keys of all suppliers, stored or not."""
    s = _table(spark, sf_dir, "supplier")
    return s.select(keyed_id(F.col("s_suppkey")).alias("id"), F.concat(F.lit("renamed "), "s_name").alias("name"), F.md5(F.concat(F.lit("new:"), "s_name")).alias("hash"))


def _leavers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(keyed_id(F.col("n_nationkey")).alias("id"))


def _insert(spark: SparkSession, sf_dir: str) -> writes.Inserted:
    return writes.insert(GUESTS, guests(spark, sf_dir), _arrivals(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records after an insert, an update and a delete."""
    stored = guests(spark, sf_dir)
    state = writes.insert_state(GUESTS, stored, _insert(spark, sf_dir))
    state = writes.update(GUESTS, state, _changes(spark, sf_dir))
    return reads.scan(GUESTS, writes.delete(GUESTS, state, _leavers(spark, sf_dir)))


def _insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insert(spark, sf_dir).refused.select("ordinal", "id", "name", "reason")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guests(spark, sf_dir).select(codec.encoded().alias("body"))


def _decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.decoded(_bodies(spark, sf_dir)).where("error is null").select("id", "name", "hash")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType(), False)])
    rows = codec.decoded(_table(spark, sf_dir, "events").select("event_id", "props"), "props", schema, None)
    return rows.select("event_id", "k", F.col("error").isNull().alias("valid"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whoever gets a name or a password: all customers."""
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"))


def _version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's version, beside how many records it serves."""
    return guests(spark, sf_dir).agg(F.version().alias("version"), F.count(F.lit(1)).alias("n_records"))


def _dsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return n.select("n_nationkey", masked_dsn(F.lower("n_name"), F.lit("localhost"), (5432 + F.col("n_regionkey")).cast("int"), F.concat(F.lit("db"), F.col("n_nationkey").cast("string"))).alias("dsn"))


QUERIES = {
    "flagship": flagship,
    "guest_scan": lambda s, d: reads.scan(GUESTS, guests(s, d)),
    "guest_lookup": lambda s, d: reads.lookup(GUESTS, guests(s, d), "c4ca4238-a0b9-4382-8dcc-509a6f75849b"),
    "guest_insert_returning": lambda s, d: _insert(s, d).accepted,
    "guest_insert_state": lambda s, d: writes.insert_state(GUESTS, guests(s, d), _insert(s, d)),
    "guest_insert_conflicts": _insert_conflicts,
    "guest_update_state": lambda s, d: writes.update(GUESTS, guests(s, d), _changes(s, d)),
    "guest_update_echo": lambda s, d: writes.update_echo(GUESTS, _changes(s, d)),
    # nations don't grow
    "guest_delete_state": lambda s, d: writes.delete(GUESTS, guests(s, d), _leavers(s, d), few=True),
    "guest_violations": lambda s, d: writes.violations(GUESTS, GUESTS.select(_arrivals(s, d))),
    "guest_json_encode": lambda s, d: guests(s, d).select("id", codec.encoded().alias("body")),
    "guest_json_list": lambda s, d: codec.encoded_list(guests(s, d)),
    "guest_json_decode": _decode,
    "events_json_decode": _events,
    "guest_json_pages": lambda s, d: codec.encoded_pages(guests(s, d)),
    "name_plain": lambda s, d: generate.names_for(_keys(s, d), "row", numbered=False),
    "name_numbered": lambda s, d: generate.names_for(_keys(s, d), "row"),
    "pass_default": lambda s, d: generate.passwords_for(_keys(s, d), "row"),
    "pass_custom": lambda s, d: generate.passwords_for(_keys(s, d), "row", CUSTOM),
    "pass_strict": lambda s, d: generate.passwords_for(_keys(s, d), "row", STRICT),
    "guests_generate": lambda s, d: generate.records_for(_keys(s, d), "row"),
    "dsn_format": _dsn,
    "server_version": _version,
}


# the same in DuckDB's SQL


def _id(key: str) -> str:
    k = f"md5({key})"
    return f"(substr({k}, 1, 8) || '-' || substr({k}, 9, 4) || '-4' || substr({k}, 14, 3) || '-8' || substr({k}, 18, 3) || '-' || substr({k}, 21, 12))"


def _draw(seed: str, row: str, n: int, position: str = "") -> str:
    tail = f" || ':' || CAST({position} AS VARCHAR)" if position else ""
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({row} AS VARCHAR){tail}), 1, 8) AS BIGINT) % {n})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _name(row: str, seed: str, numbered: bool) -> str:
    pick = lambda words, kind: f"([{', '.join(map(_quoted, words))}])[1 + {_draw(f'{seed}-{kind}', row, len(words))}]"
    out = f"{pick(ADJECTIVES, 'a')} || '-' || {pick(NOUNS, 'n')}"
    return out + (f" || '-' || lpad(CAST({_draw(f'{seed}-d', row, 10_000)} AS VARCHAR), 4, '0')" if numbered else "")


def _password(row: str, config: PasswordConfig, seed: str) -> str:
    classes = config.classes()
    alphabet, n = "".join(classes), config.length
    char = f"substr({_quoted(alphabet)}, CAST(1 + {_draw(seed, row, len(alphabet), 'i')} AS INTEGER), 1)"
    if config.strict:
        turn = f"((i - 1 + {_draw(f'{seed}-strict', row, n)}) % {n})"
        cases = " ".join(f"WHEN {k} THEN substr({_quoted(c)}, CAST(1 + {_draw(seed, row, len(c), 'i')} AS INTEGER), 1)" for k, c in enumerate(classes))
        char = f"CASE {turn} {cases} ELSE {char} END"
    return f"array_to_string(list_transform(range(1, {n + 1}), lambda i: {char}), '')"


_GUESTS = f"guests AS (SELECT {_id('CAST(c_custkey AS VARCHAR)')} AS id, c_name AS name, md5(c_mktsegment || ':' || c_name) AS hash FROM customer)"
_ARRIVALS = f"""arrivals AS (
  SELECT id, name, ordinal, md5(name) AS hash FROM (
    SELECT {_id("'s' || CAST(s_suppkey AS VARCHAR)")} AS id, s_name AS name, 4 * s_suppkey AS ordinal FROM supplier
    UNION ALL SELECT {_id('CAST(s_suppkey AS VARCHAR)')}, 'other ' || s_name, 4 * s_suppkey + 1 FROM supplier
    UNION ALL SELECT {_id("'t' || CAST(s_suppkey AS VARCHAR)")}, c_name, 4 * s_suppkey + 2 FROM supplier JOIN customer ON c_custkey = s_suppkey
    UNION ALL SELECT {_id("'u' || CAST(s_suppkey AS VARCHAR)")}, s_name, 4 * s_suppkey + 3 FROM supplier)
)"""
# no two rows of the batch clash but a supplier's first and last, of which the first comes first
_JUDGED = f"""{_GUESTS}, {_ARRIVALS}, judged AS (
  SELECT *, CASE WHEN EXISTS (SELECT 1 FROM guests g WHERE g.id = a.id) THEN 'id'
                 WHEN EXISTS (SELECT 1 FROM guests g WHERE g.name = a.name) THEN 'name'
                 WHEN EXISTS (SELECT 1 FROM arrivals b WHERE b.name = a.name AND b.ordinal < a.ordinal) THEN 'name' END AS reason
  FROM arrivals a
)"""
_CHANGES = f"changes AS (SELECT {_id('CAST(s_suppkey AS VARCHAR)')} AS id, 'renamed ' || s_name AS name, md5('new:' || s_name) AS hash FROM supplier)"
_KEYS = "keys AS (SELECT c_custkey AS r FROM customer)"
_LEAVERS = f"leavers AS (SELECT {_id('CAST(n_nationkey AS VARCHAR)')} AS id FROM nation)"
_JSON = "CAST(to_json({id: id, name: name, hash: hash}) AS VARCHAR)"
_AFTER = "SELECT {s}.id, coalesce(c.name, {s}.name) AS name, coalesce(c.hash, {s}.hash) AS hash FROM {s} LEFT JOIN changes c ON c.id = {s}.id"

ORACLES = {
    "flagship": f"WITH {_JUDGED}, {_CHANGES}, {_LEAVERS}, inserted AS (SELECT * FROM guests UNION ALL SELECT id, name, hash FROM judged WHERE reason IS NULL), updated AS ({_AFTER.format(s='inserted')}) SELECT id, name, hash FROM updated WHERE id NOT IN (SELECT id FROM leavers)",
    "guest_scan": f"WITH {_GUESTS} SELECT id, name, hash FROM guests",
    "guest_lookup": f"WITH {_GUESTS} SELECT id, name, hash FROM guests WHERE id = 'c4ca4238-a0b9-4382-8dcc-509a6f75849b'",
    "guest_insert_returning": f"WITH {_JUDGED} SELECT id, name, hash FROM judged WHERE reason IS NULL",
    "guest_insert_state": f"WITH {_JUDGED} SELECT id, name, hash FROM guests UNION ALL SELECT id, name, hash FROM judged WHERE reason IS NULL",
    "guest_insert_conflicts": f"WITH {_JUDGED} SELECT ordinal, id, name, reason FROM judged WHERE reason IS NOT NULL",
    "guest_update_state": f"WITH {_GUESTS}, {_CHANGES} {_AFTER.format(s='guests')}",
    "guest_update_echo": f"WITH {_CHANGES} SELECT id, name, hash FROM changes",
    "guest_delete_state": f"WITH {_GUESTS}, {_LEAVERS} SELECT id, name, hash FROM guests WHERE id NOT IN (SELECT id FROM leavers)",
    "guest_violations": f"WITH {_ARRIVALS} SELECT 'id' AS rule, id AS value, count(*) AS n FROM arrivals GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'name', name, count(*) FROM arrivals GROUP BY name HAVING count(*) > 1",
    "guest_json_encode": f"WITH {_GUESTS} SELECT id, {_JSON} AS body FROM guests",
    "guest_json_list": f"WITH {_GUESTS} SELECT '[' || string_agg({_JSON}, ',' ORDER BY id, name, hash) || ']' AS body FROM guests",
    "guest_json_pages": f"WITH {_GUESTS} SELECT substr(id, 1, 2) AS page, count(*) AS n, '[' || string_agg({_JSON}, ',' ORDER BY id, name, hash) || ']' AS body FROM guests GROUP BY 1",
    "guest_json_decode": f"WITH {_GUESTS}, b AS (SELECT {_JSON} AS body FROM guests) SELECT body->>'$.id' AS id, body->>'$.name' AS name, body->>'$.hash' AS hash FROM b",
    "events_json_decode": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS valid FROM events",
    "name_plain": f"WITH {_KEYS} SELECT r AS row, {_name('r', 'name', False)} AS name FROM keys",
    "name_numbered": f"WITH {_KEYS} SELECT r AS row, {_name('r', 'name', True)} AS name FROM keys",
    "pass_default": f"WITH {_KEYS} SELECT r AS row, {_password('r', PasswordConfig(), 'pass')} AS password FROM keys",
    "pass_custom": f"WITH {_KEYS} SELECT r AS row, {_password('r', CUSTOM, 'pass')} AS password FROM keys",
    "pass_strict": f"WITH {_KEYS} SELECT r AS row, {_password('r', STRICT, 'pass')} AS password FROM keys",
    "guests_generate": f"WITH {_KEYS} SELECT {_id(chr(39) + 'guest:' + chr(39) + ' || CAST(r AS VARCHAR)')} AS id, {_name('r', 'guest', True)} AS name, {_password('r', PasswordConfig(), 'guest')} AS hash FROM keys",
    "dsn_format": "SELECT n_nationkey, printf('postgres://%s:***@%s:%d/%s', lower(n_name), 'localhost', 5432 + n_regionkey, 'db' || CAST(n_nationkey AS VARCHAR)) AS dsn FROM nation",
}
