"""Names, passwords and whole records.

Draws follow from md5(seed:row:position), so a DataFrame of them doesn't depend on
partitions and comes back the same from a repeated task. They can be guessed by
whoever knows the seed: real credentials come from ``secure_password`` and ``secure_for``, which draw from
the system's entropy.
"""

from __future__ import annotations

import os
import secrets
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NameGenerationError, PasswordError
from ..schema import RECORD
from ..sources.scratch import settled
from .ids import keyed_id, random_id, random_ids

ADJECTIVES = ("amber", "brisk", "calm", "dapper", "eager", "fabled", "gentle", "hasty", "idle", "jolly", "keen", "lively", "mellow", "nimble", "opal", "plucky", "quiet", "rustic", "sunny", "tidy", "upbeat", "vivid", "witty", "zesty")
NOUNS = ("acorn", "badger", "cedar", "dune", "ember", "falcon", "grove", "harbor", "island", "jasmine", "kettle", "lantern", "meadow", "nettle", "otter", "pebble", "quarry", "river", "saddle", "thicket", "umbrella", "valley", "willow", "yarrow")

NUMBERS, LOWERCASE = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPERCASE, SYMBOLS, SPACES = LOWERCASE.upper(), "!#$%&()*+,-./:;<=>?@[]^_{}~", " "
#: Characters that ``exclude`` leaves out because they look like others.
SIMILAR = "iIl1Lo0O"
#: Characters of a password at most, so that no request asks for more memory than there is.
MAX_LENGTH = 4096


@dataclass(frozen=True)
class PasswordConfig:
    length: int = 8
    numbers: bool = True
    lowercase: bool = True
    uppercase: bool = False
    symbols: bool = False
    spaces: bool = False
    #: leave out characters that look alike
    exclude: bool = False
    #: at least one character of each class
    strict: bool = False

    def classes(self) -> list[str]:
        """The characters of each class that is on; what no password can meet is an error."""
        pairs = ((self.numbers, NUMBERS), (self.lowercase, LOWERCASE), (self.uppercase, UPPERCASE), (self.symbols, SYMBOLS), (self.spaces, SPACES))
        out = ["".join(c for c in chars if not (self.exclude and c in SIMILAR)) for on, chars in pairs if on]
        if self.length < 1:
            raise PasswordError("a password has at least one character")
        if self.length > MAX_LENGTH:
            raise PasswordError(f"a password has at most {MAX_LENGTH} characters")
        if not out:
            raise PasswordError("no class of characters is on")
        if self.strict and self.length < len(out):
            raise PasswordError("a strict password is at least as long as there are classes")
        return out

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]


def draw(seed: str, row: Column, position: Column | None, n: int | Column) -> Column:
    """A number from 0 to n - 1."""
    parts = [F.lit(seed), row.cast("string")] + ([position.cast("string")] if position is not None else [])
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint") % n


def name_column(row: Column, seed: str = "name", numbered: bool = True, adjectives=ADJECTIVES, nouns=NOUNS) -> Column:
    """adjective-noun, or adjective-noun-0000 if numbered."""
    if not adjectives or not nouns:
        raise NameGenerationError()
    pick = lambda words, kind: F.element_at(F.array(*[F.lit(w) for w in words]), (draw(f"{seed}-{kind}", row, None, len(words)) + 1).cast("int"))
    parts = [pick(adjectives, "a"), pick(nouns, "n")]
    if numbered:
        parts.append(F.lpad(draw(f"{seed}-d", row, None, 10_000).cast("string"), 4, "0"))
    return F.concat_ws("-", *parts)


def password_column(row: Column, config: PasswordConfig = PasswordConfig(), seed: str = "pass") -> Column:
    """A password. A strict one has its obligatory characters at places in a row from a drawn one on, the last place followed by the first."""
    classes = config.classes()
    alphabet, n = "".join(classes), config.length
    positions = F.slice(F.sequence(F.lit(1), F.lit(max(n, 1))), 1, n)

    def char(i: Column) -> Column:
        out = F.substring(F.lit(alphabet), (1 + draw(seed, row, i, len(alphabet))).cast("int"), 1)
        if config.strict:
            turn = (i - 1 + draw(f"{seed}-strict", row, None, n)) % n
            for k, chars in enumerate(classes):
                out = F.when(turn == k, F.substring(F.lit(chars), (1 + draw(seed, row, i, len(chars))).cast("int"), 1)).otherwise(out)
        return out

    return F.array_join(F.transform(positions, char), "")


def names_for(rows: DataFrame, key: str, seed: str = "name", numbered: bool = True) -> DataFrame:
    """The rows with a name each, which follows from the key's column; names may repeat."""
    return rows.withColumn("name", name_column(F.col(key), seed, numbered))


def passwords_for(rows: DataFrame, key: str, config: PasswordConfig = PasswordConfig(), seed: str = "pass") -> DataFrame:
    """The rows with a password each, which follows from the key's column."""
    return rows.withColumn("password", password_column(F.col(key), config, seed))


def records_for(rows: DataFrame, key: str, seed: str = "guest", config: PasswordConfig = PasswordConfig()) -> DataFrame:
    """id, name and hash for each row; the password stands in hash as it is, and whoever stores real ones has to hash them."""
    of = F.col(key)
    return rows.select(keyed_id(F.concat_ws(":", F.lit(seed), of.cast("string"))).alias("id"), name_column(of, seed, True).alias("name"), password_column(of, config, seed).alias("hash"))


def names(spark: SparkSession, count: int, seed: str = "name", numbered: bool = True) -> DataFrame:
    """row and name; names may repeat."""
    return names_for(spark.range(count).toDF("row"), "row", seed, numbered)


def passwords(spark: SparkSession, count: int, config: PasswordConfig = PasswordConfig(), seed: str = "pass") -> DataFrame:
    return passwords_for(spark.range(count).toDF("row"), "row", config, seed)


def records(spark: SparkSession, count: int, seed: str = "guest", config: PasswordConfig = PasswordConfig()) -> DataFrame:
    return records_for(spark.range(count).toDF("row"), "row", seed, config)


def fair_draws(count: int, n: int) -> np.ndarray:
    """Numbers from 0 to n - 1 from the system's entropy, each as likely as another: what lies in the last, incomplete round of n is drawn again."""
    most = (1 << 32) // n * n
    out = np.zeros(0, dtype=np.int64)
    while len(out) < count:
        drawn = np.frombuffer(os.urandom(4 * (count - len(out))), dtype=np.uint32).astype(np.int64)
        out = np.concatenate([out, drawn[drawn < most] % n])
    return out


def fair_names(count: int, numbered: bool = True) -> list[str]:
    picked = [[words[k] for k in fair_draws(count, len(words))] for words in (ADJECTIVES, NOUNS)]
    if numbered:
        picked.append([f"{k:04d}" for k in fair_draws(count, 10_000)])
    return ["-".join(x) for x in zip(*picked)]


def fair_passwords(count: int, config: PasswordConfig = PasswordConfig()) -> list[str]:
    """Passwords that can't be guessed. A strict one has a character of each class, at places that are drawn too."""
    classes = config.classes()
    alphabet = np.frombuffer("".join(classes).encode(), dtype=np.uint8)
    chars = alphabet[fair_draws(count * config.length, len(alphabet))].reshape(count, config.length)
    if config.strict:
        for k, own in enumerate(classes):
            chars[:, k] = np.frombuffer(own.encode(), dtype=np.uint8)[fair_draws(count, len(own))]
        places = np.frombuffer(os.urandom(8 * chars.size), dtype=np.uint64).reshape(chars.shape)
        chars = np.take_along_axis(chars, np.argsort(places, axis=1), axis=1)
    return [bytes(row).decode() for row in chars]


def secure_for(rows: DataFrame, config: PasswordConfig = PasswordConfig(), numbered: bool = True, path: str | None = None) -> DataFrame:
    """The rows with id, name and hash drawn from the system's entropy, which push out columns whose names read alike.

    No task draws twice for what is read: the result is written once, to ``path`` or to the session's shared folder, and read from there.
    """
    config.classes()
    plain = lambda c: "`" + c.replace("`", "``") + "`"
    keep = [c for c in rows.columns if c.lower() not in RECORD.fieldNames()]
    # in one column, so that names with dots or none at all pass; a row of no other columns has a number to be counted by
    one = F.struct(*[F.col(plain(c)) for c in keep]) if keep else F.monotonically_increasing_id()
    rows = rows.select(one.alias("__row"))
    schema = T.StructType(rows.schema.fields + RECORD.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # so many at a time that their passwords take a few megabytes
        step = max(1, (4 << 20) // (8 * config.length))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                n = len(part)
                drawn = [random_ids(n), fair_names(n, numbered), fair_passwords(n, config)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.string()) for x in drawn]], names=["__row", *RECORD.fieldNames()])

    out = rows.mapInArrow(run, schema).select(*[F.col(f"__row.{plain(c)}") for c in keep], *RECORD.fieldNames())
    if path is None:
        return settled(out)
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def secure_name(numbered: bool = True) -> str:
    parts = [secrets.choice(ADJECTIVES), secrets.choice(NOUNS)]
    return "-".join(parts + [f"{secrets.randbelow(10_000):04d}"] if numbered else parts)


def secure_password(config: PasswordConfig = PasswordConfig()) -> str:
    """A password that can't be guessed."""
    classes = config.classes()
    alphabet = "".join(classes)
    must = [secrets.choice(c) for c in classes] if config.strict else []
    chars = must + [secrets.choice(alphabet) for _ in range(config.length - len(must))]
    secrets.SystemRandom().shuffle(chars)
    return "".join(chars)


def secure_passwords(count: int, config: PasswordConfig = PasswordConfig()) -> list[str]:
    """For a request; for many there is ``secure_for``."""
    return fair_passwords(count, config)


def secure_record(config: PasswordConfig = PasswordConfig(), numbered: bool = True) -> dict[str, str]:
    """A single record that can't be guessed: a random id, a name, and a password that stands in hash as it is."""
    return {"id": random_id(), "name": secure_name(numbered), "hash": secure_password(config)}


def secure_records(count: int, config: PasswordConfig = PasswordConfig()) -> list[dict[str, str]]:
    """For a request; for many there is ``secure_for``. Names are numbered; they may repeat all the same, and a store refuses a repeated one."""
    drawn = zip(random_ids(count), fair_names(count), fair_passwords(count, config))
    return [dict(zip(RECORD.fieldNames(), x)) for x in drawn]
