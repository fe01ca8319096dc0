"""Encoding and decoding with a SentencePiece BPE model by suffix-array matching.

The units of a batch of texts that aren't known yet are laid end to end and
their suffixes sorted. Each piece of the vocabulary is looked up in them by binary
search, which gives all places where it stands; the resulting edges are sorted by
the place where they end and relaxed in that order: the edge that ends a prefix is
the one whose piece may follow the last piece of the prefix before it, that is,
no merge across their border would come before the merges that made the two.
Exactly one edge can end each prefix, so the last pieces of all prefixes, read
backwards, are the pieces that the model's own merging gives. Where no edge lies across
a place, no merge can either, and what follows is relaxed side by side with what
comes before, so a long text without spaces takes few steps.

Decoding joins the pieces, bytes and spaces again.

Defined cases: a null text is an empty one and has no ids. A character in no piece
becomes the ids of its bytes. The model writes a space and U+2581 alike, so the
latter is decoded as a space. Ids of control pieces are decoded as nothing, null
ids as an empty text, and bytes that aren't UTF-8 as U+FFFD. Other columns are kept;
those named like a result column, in upper or lower case, give way. Of an empty table
the result is empty.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .prefix_tree import _spread
from .runtime import documents, lean, row_columns, row_of
from .units import UnitMemory, piece_units

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters that are indexed at a time.
INDEX_CHARS = 100_000
#: Rows that are decoded at a time.
DECODE_ROWS = 500
_FIRST = np.uint64(0xF125)


class PieceModel:
    """Pieces, their merges and the tests on them, from a model file."""

    def __init__(self, path: str):
        import public_tokenizers
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path if os.path.sep in path else public_tokenizers.path(path))
        model = self.library
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        self.n, self.ids = n, {t: i for i, t in text.items()}
        order = sorted((i for i in plain if len(text[i]) > 1), key=lambda i: -model.get_score(i))
        self.rank = np.full(n, -1, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        keys, ranks = [], []
        for i in order:
            t = text[i]
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(self.rank[i])
        at = np.argsort(np.array(keys, dtype=np.int64))
        self.pair, self.pair_rank = np.array(keys, dtype=np.int64)[at], np.array(ranks, dtype=np.int64)[at]
        self.left, self.right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        merged = dict(zip(keys, (order[r] for r in ranks)))
        usable = []
        for i in plain:
            if len(text[i]) == 1:
                usable.append(i)
            elif (last := self._merge(text[i], merged)) is not None:
                self.left[i], self.right[i] = last
                usable.append(i)
        chars = sorted({c for i in plain for c in text[i]})
        #: 1, 2, ... for the characters of pieces, else 0
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = max(len(text[i]) for i in usable)
        self.usable = np.array(usable, dtype=np.int64)
        self.length = np.array([len(text[i]) for i in usable], dtype=np.int64)
        self.spelled = np.zeros((len(usable), self.width), dtype=np.int32)
        for row, i in enumerate(usable):
            self.spelled[row, : len(text[i])] = self.code[[ord(c) for c in text[i]]]
        #: ASCII characters that are in no piece
        self.apart = np.zeros(256, dtype=bool)
        self.apart[:128] = self.code[:128] == 0
        self.apart[32] = False
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.bytes = [b"" for _ in range(n)]
        for i, t in text.items():
            self.bytes[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id.tolist()):
            self.bytes[i] = bytes([b])
        self.bytes[model.unk_id()] = " ⁇ ".encode()
        lens = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.byte_len, self.byte_at = lens, np.cumsum(lens) - lens
        self.byte_pool = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.memory = UnitMemory(self.encode_units, 500_000)

    def _merge(self, text: str, merged: dict[int, int]) -> tuple[int, int] | None:
        """The two pieces that merging joins last if it makes one piece of the text."""
        parts = [self.ids.get(c, -1) for c in text]
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                z = merged.get(parts[k] * self.n + parts[k + 1]) if parts[k] >= 0 and parts[k + 1] >= 0 else None
                if z is not None and (best is None or self.rank[z] < best[0]):
                    best = (self.rank[z], k, z)
            if best is None:
                return None
            last = (parts[best[1]], parts[best[1] + 1])
            parts[best[1] : best[1] + 2] = [best[2]]
        return last

    def may_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether piece y may stand after piece x.

        Merges are taken back from the latest on, on either side of the border; the
        two pieces stand if at no time a merge across it was due. Of equal merges
        the left one comes first.
        """
        out = np.ones(len(x), dtype=bool)
        never = np.iinfo(np.int64).max
        limit = np.full(len(x), never)
        at = np.arange(len(x))
        while len(at):
            key = x * self.n + y
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            due = (self.pair[place] == key) & (self.pair_rank[place] < limit)
            out[at[due]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~due & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            late = rx > ry
            limit = np.where(late, rx, ry + 1)
            x, y = np.where(late, self.right[x], x), np.where(late, y, self.left[y])
        return out

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [u.decode().replace(" ", SPACE) for u in units]
        lens, ids, lo, size = [], [], 0, 0
        for hi, t in enumerate(texts):
            size += len(t)
            if size >= INDEX_CHARS or hi + 1 == len(texts):
                a, b = self._encode(texts[lo : hi + 1])
                lens.append(a)
                ids.append(b)
                lo, size = hi + 1, 0
        return np.concatenate(lens), np.concatenate(ids)

    def _words(self, codes: np.ndarray, starts: np.ndarray, bits: int) -> list[np.ndarray]:
        """The characters from each start on, packed into 64-bit words that compare as they do."""
        per = 63 // bits
        out = []
        for k in range(0, self.width, per):
            word = np.zeros(len(starts), dtype=np.int64)
            for j in range(k, min(k + per, self.width)):
                word = (word << bits) | codes[starts + j]
            out.append(word << (bits * (per - (min(k + per, self.width) - k))))
        return out

    @staticmethod
    def _bound(words: list[np.ndarray], keys: list[np.ndarray], right: bool) -> np.ndarray:
        """Binary search of all keys at once in words that are sorted."""
        n = len(words[0])
        lo, hi = np.zeros(len(keys[0]), dtype=np.int64), np.full(len(keys[0]), n, dtype=np.int64)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, n - 1)
            less = np.zeros(len(lo), dtype=bool)
            same = np.ones(len(lo), dtype=bool)
            for w, k in zip(words, keys):
                v = w[mid]
                less |= same & (v < k)
                same &= v == k
            up = (less | same if right else less) & (lo < hi)
            lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
        return lo

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        # a zero after each unit: no piece goes over it
        begin = np.cumsum(size + 1) - (size + 1)
        places = np.arange(len(points)) + np.repeat(np.arange(len(texts)), size)
        codes = self.code[points]
        present = np.unique(codes[codes > 0])
        dense = np.zeros(int(self.code.max()) + 1, dtype=np.int64)
        dense[present] = np.arange(1, len(present) + 1)
        foreign = len(present) + 1
        bits = int(foreign + 1).bit_length()
        line = np.zeros(len(points) + len(texts) + self.width, dtype=np.int64)
        line[places] = np.where(codes > 0, dense[codes], foreign)
        # the suffix array, as far as the longest piece reaches
        words = self._words(line, places, bits)
        order = np.lexsort(words[::-1])
        suffixes = places[order]
        words = [w[order] for w in words]
        spelled = dense[self.spelled]
        rows = np.flatnonzero(((spelled > 0) | (self.spelled == 0)).all(axis=1))
        spelled, length, ids = spelled[rows], self.length[rows], self.usable[rows]
        flat = np.arange(len(rows)) * self.width
        past = np.arange(self.width)[None, :] >= length[:, None]
        low = self._bound(words, self._words(spelled.ravel(), flat, bits), False)
        high = self._bound(words, self._words(np.where(past, (1 << bits) - 1, spelled).ravel(), flat, bits), True)
        count = high - low
        start = suffixes[_spread(low, count)]
        piece, stop = np.repeat(ids, count), start + np.repeat(length, count)
        strange = places[codes == 0]
        start, stop = np.concatenate([start, strange]), np.concatenate([stop, strange + 1])
        piece = np.concatenate([piece, np.full(len(strange), -1, dtype=np.int64)])
        # places that no edge lies across
        over = np.zeros(len(line) + 1, dtype=np.int64)
        np.add.at(over, start + 1, 1)
        np.add.at(over, stop, -1)
        free = np.cumsum(over)[: len(line)] == 0
        free[begin] = True
        head = np.maximum.accumulate(np.where(free, np.arange(len(line)), 0))
        # edges by where they end in their stretch; all stretches are relaxed side by side
        depth = stop - head[start]
        order = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        start, stop, piece, depth = start[order], stop[order], piece[order], depth[order]
        bounds = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
        last = np.full(len(line), -9, dtype=np.int64)
        back = np.zeros(len(line), dtype=np.int64)
        for d in range(len(bounds) - 1):
            part = slice(bounds[d], bounds[d + 1])
            p, q, t = start[part], stop[part], piece[part]
            before = last[p]
            ok = free[p] | (t == -1)
            both = np.flatnonzero(~ok & (before >= 0))
            ok[both] = self.may_follow(before[both], t[both])
            last[q[ok]], back[q[ok]] = t[ok], p[ok]
        ends = begin + size
        if (last[ends] == -9).any():
            raise ValueError("the model's merges don't reach every prefix")
        at = np.flatnonzero(size > 0)
        place = ends[at]
        out_unit, out_piece, out_place = [], [], []
        while len(at):
            out_unit.append(at)
            out_piece.append(last[place])
            out_place.append(back[place])
            place = back[place]
            go = place > begin[at]
            at, place = at[go], place[go]
        if not out_unit:
            return size, np.zeros(0, dtype=np.int32)
        of, token, place = (np.concatenate(x) for x in (out_unit, out_piece, out_place))
        order = np.lexsort((place, of))
        of, token, place = of[order], token[order], place[order]
        point = np.zeros(len(line), dtype=np.int64)
        point[places] = points
        alien = np.flatnonzero(token == -1)
        if len(alien):
            raw = [chr(c).encode() for c in point[place[alien]].tolist()]
            times = np.ones(len(token), dtype=np.int64)
            times[alien] = [len(x) for x in raw]
            head = np.cumsum(times) - times
            of, token = np.repeat(of, times), np.repeat(token, times)
            token[_spread(head[alien], times[alien])] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return np.bincount(of, minlength=len(texts)), token.astype(np.int32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        n = len(off) - 1
        starts, ends = piece_units(data, off, self.apart)
        keys = tb.run_hashes(data, starts, ends)
        of = tb.text_of(starts, off)
        # the model puts a space before each text
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=bool)
        keys[first] = tb.mix(keys[first] + _FIRST)
        at, lens, _ = self.memory.look_up(data, starts, ends, keys, lambda i: b" " if first[i] else b"")
        return np.bincount(of, weights=lens, minlength=n).astype(np.int64), self.memory.gather(at, lens)

    def decode(self, lens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, and their offsets, for the number of ids of each text and all ids."""
        size = self.byte_len[ids]
        raw = self.byte_pool[_spread(self.byte_at[ids], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        off = total[np.concatenate([[0], np.cumsum(lens)])]
        begin = np.flatnonzero(off[1:] > off[:-1])
        # the space before the text, if the first piece has one
        head_id = ids[(np.cumsum(lens) - lens)[begin]]
        space = begin[(raw[off[begin]] == 32) & (head_id != self.byte_id[32])]
        keep = np.ones(len(raw), dtype=bool)
        keep[off[space]] = False
        gone = np.zeros(len(off), dtype=np.int64)
        gone[1:] = np.cumsum(np.bincount(space, minlength=len(lens)))
        return raw[keep], off - gone


_models: dict[str, PieceModel] = {}


def piece_model(path: str = MODEL) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """All columns of ``docs`` but the text, and ids."""
    rows = docs.select(row_of(docs, text, "ids"), F.col(text).alias("__text"))
    schema = T.StructType([rows.schema["__row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in tb.slices(batch.column(1)):
                lens, ids = piece_model(model).encode(data, off)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["__row", "ids"])

    return rows.mapInArrow(lean(run), schema).select(*row_columns(docs, text, "ids"), "ids")


def _texts(model: str, lens: np.ndarray, ids: np.ndarray) -> list[str]:
    raw, off = piece_model(model).decode(lens, ids)
    body = raw.tobytes()
    return [body[a:b].decode(errors="replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def decode_documents(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """All columns of ``encoded``, and decoded."""
    rows = encoded.select(row_of(encoded, "decoded"), F.col(ids).alias("__ids"))
    schema = T.StructType([rows.schema["__row"], T.StructField("decoded", T.StringType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(lo, DECODE_ROWS)
                got = part.column(1).fill_null([])
                texts = _texts(model, np.diff(got.offsets.to_numpy()), got.flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["__row", "decoded"])

    return rows.mapInArrow(lean(run), schema).select(*row_columns(encoded, "decoded"), "decoded")


def decoded_digest(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """As ``decode_documents``, with n_ids and ids_crc32 (of the ids as little-endian 32-bit integers) in place of the ids.

    One worker reads the ids once for both.
    """
    new = ["n_ids", "ids_crc32", "decoded"]
    rows = encoded.select(row_of(encoded, ids, *new), F.col(ids).alias("__ids"))
    schema = T.StructType([rows.schema["__row"], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(lo, DECODE_ROWS)
                got = part.column(1).fill_null([])
                lens = np.diff(got.offsets.to_numpy())
                flat = got.flatten().to_numpy(zero_copy_only=False)
                stop = np.cumsum(lens)
                raw = flat.astype("<i4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((stop - lens).tolist(), stop.tolist())]
                columns = [pa.array(lens.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(_texts(model, lens, flat), pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.fieldNames())

    return rows.mapInArrow(lean(run), schema).select(*row_columns(encoded, ids, *new), *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    docs = docs.select("doc_id", F.crc32(F.encode(F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" ")), "UTF-8")).alias("text_crc32"), "text")
    out = decoded_digest(encode_documents(docs))
    decoded = F.crc32(F.encode("decoded", "UTF-8"))
    return out.select("doc_id", "n_ids", "ids_crc32", "text_crc32", (decoded == F.col("text_crc32")).alias("round_trip"))
