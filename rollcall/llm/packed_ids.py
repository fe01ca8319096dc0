"""Token ids in files of 64-bit words (Simple-8b), written in the order of ids of documents and read back.

A file holds the ids of a run of documents. Its distinct ids are ranked by
frequency, and ranks, which are small where ids are common, are packed: blocks
of ``BLOCK`` ranks, each a row of 64-bit words whose top four bits select how many
values of how many bits the other sixty hold. A value of more than sixty bits is
an escape word followed by the value as it is. The offsets of the blocks' words
stand in the file, so all blocks are decoded at once, selector by selector.

Layout, little-endian: 8 bytes magic; five uint64 (documents, values, blocks,
words, distinct values); document ids (int64); flags of null document ids (uint8,
padded to 8); values of each document (uint64); block offsets in words (uint64,
one more than blocks); distinct values by rank (uint64); words (uint64).

Defined cases: a null text is an empty one and has the end id alone. Rows of one
document id stand in the order of a hash of their texts. Null ids come first. Of an
empty table no file is written and the result is empty. Other columns are left out,
whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .prefix_tree import _spread
from .runtime import documents, in_order, lean, passing, scratch, summed_before, written
from .units import UnitMemory, bare_units, encoder, lowered_safely, special_strings, texts_with
from .whole_tokens import load_tokenizer

TOKENIZER, END_ID = "word_bpe_49k.json", 1
MAGIC = b"S8BRANK1"
BLOCK = 1024
#: Blocks that are packed at a time.
PACKED_BLOCKS = 256
#: A file is closed when it has so many ids.
FILE_IDS = 1_000_000
#: Bytes of texts that a task writes, about.
TASK_BYTES = 16 << 20
#: Bytes of texts that are encoded at a time.
ENCODED_BYTES = 1 << 20
ESCAPE = 15
#: What reading gives.
READ = "file string, nth long, doc_id long, offset long, ids array<long>"
#: values in a word, and bits of each, by selector
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offset of each block's words (one more than blocks)."""
    words, offsets = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.uint64)]
    for lo in range(0, len(values), PACKED_BLOCKS * BLOCK):
        w, o = _pack(values[lo : lo + PACKED_BLOCKS * BLOCK])
        words.append(w)
        offsets.append(o[1:] + offsets[-1][-1])
    return np.concatenate(words), np.concatenate(offsets)


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    blocks = -(-n // BLOCK)
    # places beyond a block's end count as zeros, so a block's last word may be partly empty
    wide = BLOCK + int(COUNT.max())
    grid = np.zeros((blocks, wide), dtype=np.uint64)
    flat = np.zeros(blocks * BLOCK, dtype=np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    choice = np.full((blocks, BLOCK), ESCAPE, dtype=np.uint8)
    for k in range(len(COUNT) - 1, -1, -1):
        over = np.zeros((blocks, wide + 1), dtype=np.int32)
        np.cumsum(grid >= np.uint64(1 << int(BITS[k])), axis=1, out=over[:, 1:], dtype=np.int32)
        fits = over[:, COUNT[k] : COUNT[k] + BLOCK] == over[:, :BLOCK]
        choice[fits] = k
    step = np.append(COUNT, [0, 1])
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    place, row = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    rows, places, chosen = [], [], []
    while len(row):
        k = choice[row, place]
        rows.append(row)
        places.append(place)
        chosen.append(k)
        place = place + step[k]
        go = place < length[row]
        row, place = row[go], place[go]
    row, place, k = np.concatenate(rows), np.concatenate(places), np.concatenate(chosen)
    order = np.lexsort((place, row))
    row, place, k = row[order], place[order], k[order]
    size = np.where(k == ESCAPE, 2, 1)
    at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    for s in range(len(COUNT)):
        which = np.flatnonzero(k == s)
        if len(which):
            value = np.full(len(which), np.uint64(s) << np.uint64(60))
            for j in range(COUNT[s]):
                value |= grid[row[which], place[which] + j] << np.uint64(j * int(BITS[s]))
            words[at[which]] = value
    which = np.flatnonzero(k == ESCAPE)
    words[at[which]] = np.uint64(ESCAPE) << np.uint64(60)
    words[at[which] + 1] = grid[row[which], place[which]]
    offsets = np.zeros(blocks + 1, dtype=np.uint64)
    offsets[1:] = np.cumsum(np.bincount(row, weights=size, minlength=blocks)).astype(np.uint64)
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The values again; every block begins at its own offset."""
    blocks = len(offsets) - 1
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    escapes = np.flatnonzero(selector == ESCAPE)
    if len(escapes):
        # a raw value may look like an escape itself: a run of such words is read in turns from its first
        first = np.concatenate([[True], np.diff(escapes) > 1]) | np.isin(escapes, offsets[:-1].astype(np.int64))
        since = np.arange(len(escapes)) - np.maximum.accumulate(np.where(first, np.arange(len(escapes)), 0))
        escapes = escapes[since % 2 == 0]
        raw[escapes + 1] = True
    heads = np.flatnonzero(~raw)
    count = np.append(COUNT, [0, 1])[selector[heads]]
    block = np.searchsorted(offsets.astype(np.int64), heads, side="right") - 1
    before = np.cumsum(count) - count
    first = np.searchsorted(block, np.arange(blocks))
    place = before - before[first][block] + block * BLOCK
    out = np.zeros(blocks * BLOCK + int(COUNT.max()), dtype=np.uint64)
    limit = np.minimum((block + 1) * BLOCK, n)
    for s in range(len(COUNT)):
        which = np.flatnonzero(selector[heads] == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNT[s]) if len(which) else ():
            to = place[which] + j
            ok = to < limit[which]
            out[to[ok]] = (words[heads[which[ok]]] >> np.uint64(j * int(BITS[s]))) & mask
    which = np.flatnonzero(selector[heads] == ESCAPE)
    out[place[which]] = words[heads[which] + 1]
    return out[:n]


def file_bytes(doc_ids: list[int | None], lens: np.ndarray, values: np.ndarray) -> bytes:
    if not len(values) or values.max() < 1 << 20:
        # a vocabulary's ids: counted in place
        count = np.bincount(values.astype(np.int64))
        distinct = np.flatnonzero(count)
        count, inverse = count[distinct], values
        rank = np.zeros(int(distinct.max(initial=0)) + 1, dtype=np.uint64)
        seat = distinct
    else:
        distinct, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
        rank = np.zeros(len(distinct), dtype=np.uint64)
        seat = np.arange(len(distinct))
    order = np.argsort(-count, kind="stable")
    rank[seat[order]] = np.arange(len(order), dtype=np.uint64)
    words, offsets = pack(rank[inverse])
    head = np.array([len(doc_ids), len(values), len(offsets) - 1, len(words), len(distinct)], dtype="<u8")
    null = np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes()
    null += b"\0" * (-len(null) % 8)
    ids = np.array([x or 0 for x in doc_ids], dtype="<i8")
    return b"".join([MAGIC, head.tobytes(), ids.tobytes(), null, lens.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), distinct[order].astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, the number of values of each, and all values."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of packed ids")
    docs, n, blocks, words, distinct = np.frombuffer(raw, dtype="<u8", count=5, offset=8).astype(np.int64).tolist()
    at = 48
    ids = np.frombuffer(raw, dtype="<i8", count=docs, offset=at)
    at += 8 * docs
    null = np.frombuffer(raw, dtype=np.uint8, count=docs, offset=at)
    at += docs + -docs % 8
    lens = np.frombuffer(raw, dtype="<u8", count=docs, offset=at).astype(np.int64)
    at += 8 * docs
    offsets = np.frombuffer(raw, dtype="<u8", count=blocks + 1, offset=at)
    at += 8 * (blocks + 1)
    by_rank = np.frombuffer(raw, dtype="<u8", count=distinct, offset=at)
    at += 8 * distinct
    values = by_rank[unpack(np.frombuffer(raw, dtype="<u8", count=words, offset=at), offsets, n).astype(np.int64)] if n else np.zeros(0, dtype=np.uint64)
    return [None if z else i for i, z in zip(ids.tolist(), null.tolist())], lens, values


class Encoder:
    """Ids of texts by units; one for each worker process."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.memory = UnitMemory(encoder(self.tokenizer))
        self.special = special_strings(self.tokenizer)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text with its end id, and all ids."""
        n = len(off) - 1
        low = lowered_safely(data)
        starts, ends = bare_units(low, off)
        at, lens, _ = self.memory.look_up(low, starts, ends, tb.run_hashes(low, starts, ends))
        ids = self.memory.gather(at, lens)
        per_text = np.bincount(tb.text_of(starts, off), weights=lens, minlength=n).astype(np.int64)
        stop = np.cumsum(per_text)
        whole = texts_with(data, off, self.special)
        if whole:
            parts = np.split(ids, stop[:-1])
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, dtype=np.int32)
            per_text = np.array([len(x) for x in parts], dtype=np.int64)
            ids, stop = np.concatenate(parts), np.cumsum(per_text)
        return per_text + 1, np.insert(ids, stop, end_id)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, file_ids: int = FILE_IDS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Writes the files into a shared folder, and returns file, n_docs and n_ids of each.

    Tasks take ranges of document ids, so the order of file names is the order
    of documents. A file is written under a name of its attempt and then renamed,
    so a repeated task leaves one whole file.
    """

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        held: list = []
        made = 0

        def close():
            nonlocal held, made
            name = f"part-{context.partitionId():06d}-{made:06d}.s8b"
            ids, lens, values = [i for x in held for i in x[0]], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            draft = f"{root}/_{context.taskAttemptId()}-{name}"
            with store.open_output_stream(draft) as out:
                out.write(file_bytes(ids, lens, values))
            store.move(draft, f"{root}/{name}")
            held, made = [], made + 1
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(ids)], "n_ids": [len(values)]})

        for batch in batches:
            for lo, hi, data, off in tb.slices(batch.column(1), min(ENCODED_BYTES, 3 * file_ids)):
                lens, ids = _encoder(tokenizer).encode(data, off, end_id)
                held.append((batch.column(0).slice(lo, hi - lo).to_pylist(), lens, ids))
                if sum(len(x[2]) for x in held) >= file_ids:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = in_order(rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))), n_bytes, "doc_id", "tie", part_bytes=task_bytes)
    return written(rows.select("doc_id", "text").mapInArrow(lean(run), "file string, n_docs long, n_ids long"), "packed-list")


def read_files(spark: SparkSession, folder: str, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = READ) -> DataFrame:
    """file, nth (the place in the file), doc_id, offset (ids before it in the file) and ids of each document.

    each: what the worker that decodes makes of these rows, and schema what comes out, so that ids needn't leave it.
    """

    def decoded(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, lens, values = read_file(raw.as_buffer().to_pybytes())
                before = np.cumsum(lens) - lens
                for lo in range(0, len(ids), 500):
                    part = slice(lo, lo + 500)
                    a, b = int(before[lo]), int(before[part][-1] + lens[part][-1])
                    offsets = np.append(before[part] - a, b - a).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[a:b].astype(np.int64)))
                    n = len(ids[part])
                    yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)] * n), pa.array(np.arange(lo, lo + n)), pa.array(ids[part], pa.int64()), pa.array(before[part]), lists], names=["file", "nth", "doc_id", "offset", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder).select("path", "content")
    return files.mapInArrow(lean(lambda batches: each(decoded(batches)) if each else decoded(batches)), schema)


def _digest(batches):
    for batch in batches:
        file, _, doc_id, offset, lists = batch.columns
        off = lists.offsets.to_numpy()
        raw = lists.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([file, doc_id, offset, pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "offset", "n_tokens", "ids_crc32"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "packed-ids")
    made = write_files(documents(spark, sf_dir, "doc_id", "text"), folder)
    if not made.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    with passing(spark) as keep:
        made = written(summed_before(made.select("file", "n_ids"), ["file"], {"before": "n_ids"}, "packed-files").select("file", "before"), "packed-starts", keep)
    read = read_files(spark, folder, _digest, "file string, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return read.join(made, "file").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
