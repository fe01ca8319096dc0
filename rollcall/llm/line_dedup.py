"""Lines that many documents share, found by probing a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
``min_chars`` code points are hashed to 128 bits; counting them by hash gives, for those found in
at least ``min_docs`` documents, the number of documents and the largest doc_id. Each shard of
these hashes becomes a minimal perfect hash, built by a task of its own: cascading bitmaps in
which a key owns the bit that it alone falls on, so that a bit's rank is the key's slot. The slots
index arrays of fingerprints (64 bits, which tell strangers), counts and largest doc_ids, about
21 bytes a key in all. Documents then probe the arrays and no line is joined to a line.

An index of at most ``INDEX_BYTES`` is sent to all workers and probed while documents are read. A
larger one stays where it is: the hashes of the documents' lines are sent to its shards, a shard
is loaded once and answers them as they pass, and only the answers are joined back to documents.

Defined cases: a null or empty text is one empty line. A row is a document: repeated rows count as
often as they stand there, and rows with the same doc_id keep or lose a line together. A null doc_id
is below all others. A key counts once for each document, however often it stands there, and the
document with the largest doc_id keeps all its lines of the key. Of an empty table the result is empty. Input
columns named like a result column, in upper or lower case, give way; other names don't matter. Hashes of
two of a billion billion different keys agree with a chance of one in 10^20 or so, and count as one key then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .runtime import discard, documents, lean, row_columns, row_of, schema_with, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard, about.
SHARD_KEYS = 1 << 17
#: Bytes of an index that is sent to all workers, at most.
INDEX_BYTES = 64 << 20
#: Bytes of a slot in a shard's arrays, with its share of the bitmaps, at most.
SLOT_BYTES = 25
#: Bits of a level for each key that it is given.
SPREAD = 2
NO_ID = -(1 << 63)

NEW = ["n_lines", "n_dropped", "kept_text"]
SHARD = "shard int, n_keys long, sizes binary, words binary, fingerprints binary, counts binary, keepers binary"


class PerfectHash:
    """A minimal perfect hash of pairs of 64-bit words: ``slots`` numbers its keys from 0 without gaps."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(words), out=self.ranks[1:])

    @staticmethod
    def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (tb.mix(h1 ^ tb.mix(h2 + np.uint64(level))) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """The pairs must differ."""
        sizes, levels = [], []
        while len(h1):
            bits = 64 * -(-SPREAD * len(h1) // 64)
            place = cls._place(h1, h2, len(sizes), bits)
            alone = np.bincount(place, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(bits)
            left = ~alone[place]
            h1, h2 = h1[left], h2[left]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, dtype=np.uint64))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; of another pair, any slot or -1."""
        out = np.full(len(h1), -1, dtype=np.int64)
        open_, base = np.arange(len(h1)), 0
        for level, bits in enumerate(self.sizes):
            place = self._place(h1[open_], h2[open_], level, int(bits))
            word, bit = base + (place >> 6), (place & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            word, bit = word[found], bit[found]
            out[open_[found]] = self.ranks[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            open_, base = open_[~found], base + int(bits) // 64
        return out


class Shard:
    """The arrays of one shard."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(np.frombuffer(row["sizes"], dtype=np.int64), np.frombuffer(row["words"], dtype=np.uint64))
        self.fingerprints = np.frombuffer(row["fingerprints"], dtype=np.uint64)
        self.counts = np.frombuffer(row["counts"], dtype="<u8" if len(row["counts"]) > 4 * row["n_keys"] else "<u4")
        self.keepers = np.frombuffer(row["keepers"], dtype=np.int64)

    @staticmethod
    def built(shard: int, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> dict:
        found = PerfectHash.of(h1, h2)
        at = np.empty(len(h1), dtype=np.int64)
        at[found.slots(h1, h2)] = np.arange(len(h1))
        counts = counts[at]
        wide = len(counts) and int(counts.max()) >= 1 << 32
        arrays = {"sizes": found.sizes, "words": found.words, "fingerprints": h2[at], "counts": counts.astype("<u8" if wide else "<u4"), "keepers": keepers[at]}
        return {"shard": shard, "n_keys": len(h1)} | {k: v.tobytes() for k, v in arrays.items()}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each pair is a key, and the count and the largest doc_id of those that are."""
        slot = self.hash.slots(h1, h2)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == h2[known]
        return known, self.counts[slot[known]].astype(np.int64), self.keepers[slot[known]]


class Lines:
    """The lines of the texts of a slice: where they stand, and the hashes of the keys that are long enough."""

    def __init__(self, data: np.ndarray, off: np.ndarray, min_chars: int):
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
        self.ends = np.sort(np.concatenate([breaks, off[1:]]))
        self.n_lines = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
        self.text = np.repeat(np.arange(len(off) - 1), self.n_lines)
        solid = np.flatnonzero(~tb.SPACE[data])
        a, b = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        chars = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        line = np.flatnonzero(b > a)
        begin, end = solid[a[line]], solid[b[line] - 1] + 1
        long = chars[end] - chars[begin] >= min_chars
        #: the lines whose keys are long enough, and their keys' hashes
        self.line, begin, end = line[long], begin[long], end[long]
        low = tb.lowered(data)
        self.h1 = tb.run_hashes(low, begin, end)
        # every byte meets another place of the hash's table
        self.h2 = tb.run_hashes(255 - low, begin, end)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, h1 and h2, once for each key of each text, in the order of keys."""
        text = self.text[self.line]
        order = np.lexsort((text, self.h2, self.h1))
        text, h1, h2 = text[order], self.h1[order], self.h2[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return text[new], h1[new], h2[new]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def shard_of(h1: np.ndarray, n: int) -> np.ndarray:
    return ((h1 >> np.uint64(17)) % np.uint64(n)).astype(np.int32)


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """h1, h2, n_docs and keeper (the largest doc_id) of the keys that enough documents hold, from doc_id and text."""

    def run(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            for lo, hi, data, off in tb.slices(batch.column(1)):
                text, h1, h2 = Lines(data, off, min_chars).distinct()
                if not len(text):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
                counts = np.diff(np.append(new, len(text)))
                keepers = np.maximum.reduceat(ids[lo:hi][text], new)
                yield pa.RecordBatch.from_arrays([pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64)), pa.array(counts), pa.array(keepers)], names=["h1", "h2", "n", "keeper"])

    found = docs.mapInArrow(lean(run), "h1 long, h2 long, n long, keeper long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("keeper").alias("keeper")).where(F.col("n_docs") >= min_docs)


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The index, a row for each shard, the number of shards and that of keys; from doc_id and text."""
    paths: list[str] = []
    keys = written(repeated_keys(docs, min_chars, min_docs), "line-keys", paths)
    n_keys = keys.count()
    n = max(1, -(-n_keys // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        column = lambda x: table[x].to_numpy()
        row = Shard.built(int(table["shard"][0].as_py()), column("h1").view(np.uint64), column("h2").view(np.uint64), column("n_docs"), column("keeper"))
        return pa.Table.from_pylist([row], schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("n_keys", pa.int64())] + [(x, pa.binary()) for x in ("sizes", "words", "fingerprints", "counts", "keepers")])
    shards = keys.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 17), F.lit(n)).cast("int")).groupBy("shard").applyInArrow(build, SHARD)
    index = written(shards, "line-index")
    discard(docs.sparkSession, paths)
    return index, n, n_keys


def _without(data: np.ndarray, off: np.ndarray, lines: Lines, dropped: np.ndarray) -> pa.Array:
    """The texts without the lines that the flags name."""
    raw = data.tobytes()
    first = np.zeros(len(off), dtype=np.int64)
    np.cumsum(lines.n_lines, out=first[1:])
    hit = np.zeros(len(off) - 1, dtype=bool)
    hit[lines.text[dropped]] = True
    out = []
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if hit[k]:
            stay = first[k] + np.flatnonzero(~dropped[first[k] : first[k + 1]])
            out.append(b"\n".join([raw[x:y] for x, y in zip(lines.starts[stay].tolist(), lines.ends[stay].tolist())]))
        else:
            out.append(raw[a:b])
    return pa.array(out, pa.binary()).cast(pa.string())


def _result(batch: pa.RecordBatch, parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
    whole = lambda k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    texts = pa.concat_arrays([p[2] for p in parts]) if parts else pa.array([], pa.string())
    return tb.with_columns(batch, {"n_lines": pa.array(whole(0)), "n_dropped": pa.array(whole(1)), "kept_text": texts})


def _sent(rows: DataFrame, index: DataFrame, n: int, min_chars: int) -> DataFrame:
    """The documents, judged by an index that every worker has. rows: __row, __id and __text."""
    table = rows.sparkSession.sparkContext.broadcast(sorted(index.toArrow().to_pylist(), key=lambda r: r["shard"]))
    schema = schema_with(rows.select("__row"), [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches):
        shards = {r["shard"]: Shard(r) for r in table.value}
        for batch in batches:
            ids, parts = _ids(batch.column(1)), []
            for lo, hi, data, off in tb.slices(batch.column(2)):
                lines = Lines(data, off, min_chars)
                own = ids[lo:hi][lines.text[lines.line]]
                at = shard_of(lines.h1, n)
                dropped = np.zeros(len(lines.text), dtype=bool)
                for k, shard in shards.items():
                    mine = np.flatnonzero(at == k)
                    known, _, keepers = shard.probe(lines.h1[mine], lines.h2[mine])
                    mine = mine[known]
                    dropped[lines.line[mine[own[mine] != keepers]]] = True
                parts.append((lines.n_lines, np.bincount(lines.text[dropped], minlength=hi - lo), _without(data, off, lines, dropped)))
            yield _result(batch.select([0]), parts)

    return rows.mapInArrow(lean(run), schema)


def _routed(rows: DataFrame, index: DataFrame, n: int, min_chars: int) -> DataFrame:
    """The same by an index of any size: hashes go to the shards, answers come back to the documents."""
    rows = rows.withColumn("__sum", F.unhex(F.md5(F.coalesce("__text", F.lit("")))))
    fields = ["shard", "n_keys", "sizes", "words", "fingerprints", "counts", "keepers"]

    def ask(batches):
        for batch in batches:
            ids, sums = _ids(batch.column(0)), batch.column(1)
            for lo, hi, data, off in tb.slices(batch.column(2)):
                text, h1, h2 = Lines(data, off, min_chars).distinct()
                at = shard_of(h1, n)
                order = np.argsort(at, kind="stable")
                ends = np.flatnonzero(np.diff(at[order], append=-1)) + 1
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    mine = order[a:b]
                    # 16 bytes a sum: a document without text has one as well
                    own = sums.slice(lo, hi - lo).take(pa.array(text[mine]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(at[mine[0]])], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (h1[mine], h2[mine], ids[lo:hi][text[mine]])], pa.array([b"".join(own.to_pylist())], pa.binary())],
                        names=["shard", "h1", "h2", "ids", "sums"],
                    )

    def answer(batches):
        now, shard = -1, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["asks"] == 0:
                    now, shard = row["shard"], Shard(row)
                elif row["shard"] == now:
                    h1, h2, ids = (np.frombuffer(row[x], dtype=t) for x, t in (("h1", np.uint64), ("h2", np.uint64), ("ids", np.int64)))
                    known, _, keepers = shard.probe(h1, h2)
                    at = np.flatnonzero(known)
                    at = at[ids[at] != keepers]
                    sums = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(h1), [None, pa.py_buffer(row["sums"])]).take(pa.array(at)).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), sums, pa.array(h1[at].view(np.int64))], names=["id", "sum", "h1"])

    asked = rows.select("__id", "__sum", "__text").mapInArrow(lean(ask), "shard int, h1 binary, h2 binary, ids binary, sums binary")
    index = index.select(*fields, F.lit(0).alias("asks"))
    both = index.unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    # a shard stands before what asks it
    met = both.repartition("shard").sortWithinPartitions("shard", "asks")
    drops = met.mapInArrow(lean(answer), "id long, sum binary, h1 long").groupBy("id", "sum").agg(F.collect_set("h1").alias("__drop"))
    drops = drops.select(F.col("id").alias("__of"), F.col("sum").alias("__of_sum"), "__drop")
    met = rows.join(drops, (F.coalesce("__id", F.lit(NO_ID)) == F.col("__of")) & (F.col("__sum") == F.col("__of_sum")), "left").select("__row", "__text", "__drop")
    schema = schema_with(rows.select("__row"), [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches):
        for batch in batches:
            parts = []
            for lo, hi, data, off in tb.slices(batch.column(1)):
                lines = Lines(data, off, min_chars)
                drop = batch.column(2).slice(lo, hi - lo)
                of, values = drop.value_parent_indices().to_numpy(), drop.flatten().to_numpy().view(np.uint64)
                dropped = np.zeros(len(lines.text), dtype=bool)
                if len(of):
                    pairs = np.stack([of.astype(np.uint64), values], axis=1)
                    own = np.stack([lines.text[lines.line].astype(np.uint64), lines.h1], axis=1)
                    both = lambda x: np.ascontiguousarray(x).view("V16").ravel()
                    dropped[lines.line[np.isin(both(own), both(pairs))]] = True
                parts.append((lines.n_lines, np.bincount(lines.text[dropped], minlength=hi - lo), _without(data, off, lines, dropped)))
            yield _result(batch.select([0]), parts)

    return met.mapInArrow(lean(run), schema)


def drop_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index_bytes: int = INDEX_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, the text without lines that ``min_docs`` documents share.

    ``index_bytes`` bounds what is sent to all workers; ``shard_keys`` is the size of a shard.
    """
    index, n, n_keys = build_index(docs.select(F.col(key).cast("long"), F.col(text)), min_chars, min_docs, shard_keys)
    rows = docs.select(row_of(docs, *NEW), F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    # a shard's bitmaps take 64 bits a level at least
    sent = n_keys * SLOT_BYTES + n * 1024 <= index_bytes
    out = (_sent if sent else _routed)(rows, index, n, min_chars)
    return out.select(*row_columns(docs, *NEW), *NEW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH l AS (
  SELECT rid, doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), r AS (
  SELECT k, count(DISTINCT rid) AS n, max(doc_id) AS keeper FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT rid) >= {MIN_DOCS}
), j AS (
  SELECT l.*, r.k IS NOT NULL AND l.doc_id IS DISTINCT FROM r.keeper AS gone FROM l LEFT JOIN r USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
