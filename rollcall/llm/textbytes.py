"""Vectorised work on the UTF-8 bytes of a batch of texts.

Every function takes the bytes of several texts laid end to end (``data``) and
the ``offsets`` of the texts in them, as Arrow stores a string column, so no
Python string is made for a word. Hashes are 64-bit and depend on nothing but
the bytes, so they agree between tasks, workers and sessions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes at most (a longer text is a step of its own).
SLICE_BYTES = 3 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = np.array(x, dtype=np.uint64, copy=True)
    x += _GOLD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(64 * 256, dtype=np.uint64))


def byte_set(chars: bytes) -> np.ndarray:
    """A lookup table of 256 booleans."""
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Space, and U+0009 to U+000D: what separates words.
SPACE = byte_set(b" \t\n\v\f\r")
UPPER = byte_set(bytes(range(65, 91)))
LETTER = byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))
WORDISH = LETTER | byte_set(b"0123456789") | (np.arange(256) >= 128)


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return data + (UPPER[data].view(np.uint8) << np.uint8(5))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that lie in one text."""
    n = len(mask)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = mask[cut]
    last[cut - 1] = mask[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def text_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of the text that each position lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def byte_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each byte of each run, by byte and place in its stretch of 64 bytes, and where each run begins in them."""
    lens = (ends - starts).astype(np.int32)
    at = np.zeros(len(lens), dtype=np.int32)
    np.cumsum(lens[:-1], out=at[1:])
    total = int(lens.sum())
    place = np.arange(total, dtype=np.int32)
    where = place + np.repeat((starts - at).astype(np.int32), lens)
    place -= np.repeat(at, lens)
    return _TABLE[((place & 63) << 8) | data[where]], at


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; no run may be empty.

    The values of a stretch of 64 bytes are added up. Each sum but the first is mixed with its
    stretch's number before the sums of a run are added, so stretches can't change places.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    values, at = byte_values(data, starts, ends)
    lens = ends - starts
    if int(lens.max()) <= 64:
        return mix(np.add.reduceat(values, at) + lens.astype(np.uint64) * _GOLD)
    stretches = (lens + 63) // 64
    first = np.zeros(len(lens), dtype=np.int64)
    np.cumsum(stretches[:-1], out=first[1:])
    nth = np.arange(int(stretches.sum()), dtype=np.int64) - np.repeat(first, stretches)
    sums = np.add.reduceat(values, np.repeat(at.astype(np.int64), stretches) + 64 * nth)
    later = nth > 0
    sums[later] = mix(sums[later] ^ mix(nth[later].astype(np.uint64)))
    return mix(np.add.reduceat(sums, first) + lens.astype(np.uint64) * _GOLD)


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words in a row of one text, and the word that each begins with."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(text[:n] == text[size - 1 :])
    out = mix(hashes[begin] + np.uint64(size))
    for k in range(1, size):
        out = mix(out ^ hashes[begin + k])
    return out, begin


def sums_by_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text have the flag."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def count_by_text(text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, minlength=n).astype(np.int64)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with more columns; a column whose name reads alike gives way."""
    new = {x.lower() for x in columns}
    keep = [k for k, x in enumerate(batch.schema.names) if x.lower() not in new]
    return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + list(columns.values()), names=[batch.schema.names[k] for k in keep] + list(columns))
