"""Phrases whose words keep company more often than chance, mined by partitions of pivots.

Words are counted per language, and those that are frequent enough to stand in a phrase are
numbered from the most frequent on. A phrase belongs to its rarest word, the pivot (the first of
them, if it stands there twice). Texts are rewritten for that: each occurrence of a frequent word
sends the fragment around it, at most four words to each side, as far as they are frequent and none
is rarer, to the word's partition. There the phrases around the word, and no others, are counted,
so every occurrence of a phrase is counted once and in one place. Equal fragments of a block of texts travel as
one with a count. A word with very many occurrences has several partitions, and their counts are added up.

Texts are worked on in blocks of ``BLOCK_BYTES`` or one text. A block is written with the words that
it has, each once, so that the frequent ones get their numbers by a join; no table of words is sent
whole to workers or to the driver, and words are compared as they are, not by hashes.

Defined cases: a null text is empty, a null language ``und``. Repeated rows count as often as they
stand there. Words are numbered by frequency, language and text, so ties don't matter to the result.
Phrases with the same score and count stand in the order of their bytes. Of an empty table the
result is empty. Columns other than lang and text don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .runtime import discard, documents, lean, numbered, sent_whole, written

MAX_WORDS = 5
MIN_COUNT, TOP = 100, 2000
#: Bytes of the texts of a block, about.
BLOCK_BYTES = 4 << 20
#: Occurrences of a word for each of its partitions, about.
SPLIT = 1 << 18
#: Words of the texts for each partition of pivots, about.
BUCKET_WORDS = 1 << 18
#: Bytes of a word's number, so that there may be 10^12 frequent words.
ID_BYTES = 5
#: Fragments that are mined at a time, about, and fragments that are counted in one run, at most.
FRAGMENTS, TOGETHER = 100_000, 20_000

BREAK = tb.byte_set(b".,;:!?\n\v\f\r")
BLANK = tb.byte_set(b" \t")
SIDE = MAX_WORDS - 1


def word_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The words of each block, and a row with the order in which they stand.

    block, local (a word's number in the block from 1, or 0 in the row of the order), lang, word, n, and
    order: the numbers of the words of the block's texts, and 0 where a piece ends, as ``_short`` writes them. From lang and text.
    """

    def run(batches):
        made = 0
        for batch in batches:
            langs = pa.array(batch.column(0)).dictionary_encode()
            codes, names = langs.indices.to_numpy(), langs.dictionary
            for lo, hi, data, off in tb.slices(batch.column(1), block_bytes):
                low = tb.lowered(data)
                solid = ~(BREAK[low] | BLANK[low])
                starts, ends = tb.runs(solid, off)
                if not len(starts):
                    continue
                text = tb.text_of(starts, off)
                breaks = np.zeros(len(low) + 1, dtype=np.int32)
                np.cumsum(BREAK[low], out=breaks[1:])
                opens = np.ones(len(starts), dtype=bool)
                opens[1:] = (text[1:] != text[:-1]) | (breaks[starts[1:]] != breaks[ends[:-1]])
                offsets = np.zeros(len(starts) + 1, dtype=np.int64)
                np.cumsum(ends - starts, out=offsets[1:])
                words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[solid])).dictionary_encode()
                pairs = codes[lo:hi][text].astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
                distinct, local, times = np.unique(pairs, return_inverse=True, return_counts=True)
                # the most frequent words get the smallest numbers, which take the fewest bytes
                by_count = np.argsort(-times, kind="stable")
                place = np.empty(len(distinct), dtype=np.int64)
                place[by_count] = np.arange(len(distinct))
                distinct, local, times = distinct[by_count], place[local], times[by_count]
                order = np.zeros(len(starts) + int(opens.sum()), dtype=np.int64)
                order[np.arange(len(starts)) + np.cumsum(opens)] = local + 1
                n = len(distinct)
                block = (TaskContext.get().partitionId() << 33) + made
                made += 1
                nulls = lambda kind, k=n: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, block)),
                        pa.array(np.arange(n + 1, dtype=np.int32)),
                        pa.concat_arrays([nulls(pa.string(), 1), names.take(pa.array(distinct // len(words.dictionary))).cast(pa.string())]),
                        pa.concat_arrays([nulls(pa.string(), 1), words.dictionary.take(pa.array(distinct % len(words.dictionary))).cast(pa.string())]),
                        pa.array(np.append(0, times)),
                        pa.concat_arrays([pa.array([_short(order)], pa.binary()), nulls(pa.binary())]),
                    ],
                    names=["block", "local", "lang", "word", "n", "order"],
                )

    return docs.mapInArrow(lean(run), "block long, local int, lang string, word string, n long, order binary")


def _short(numbers: np.ndarray) -> bytes:
    """Numbers below 2^35 as one byte to five: seven bits in each, the last of a number with the high bit."""
    size = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21) + (numbers >= 1 << 28)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(5):
        has = np.flatnonzero(size > k)
        out[ends[has] - 1 - k] = (numbers[has] >> (7 * k)) & 127
    out[ends - 1] |= 128
    return out.tobytes()


def _long(data: bytes) -> np.ndarray:
    """The numbers that ``_short`` wrote."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw & 128)
    size = np.diff(ends, prepend=-1)
    low, out = (raw & 127).astype(np.int64), np.zeros(len(ends), dtype=np.int64)
    for k in range(5):
        has = np.flatnonzero(size > k)
        out[has] |= low[ends[has] - k] << (7 * k)
    return out


def _merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of numbers as one, their counts added."""
    if not len(rows):
        return rows, counts
    keys = tb.mix(rows[:, 0].astype(np.uint64))
    for k in range(1, rows.shape[1]):
        keys = tb.mix(keys ^ rows[:, k].astype(np.uint64))
    order = np.argsort(keys)
    keys, rows, counts = keys[order], rows[order], counts[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    if (~new[1:] & (rows[1:] != rows[:-1]).any(axis=1)).any():
        # two rows with one key: rows themselves are sorted
        order = np.lexsort(rows.T)
        rows, counts = rows[order], counts[order]
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(counts, at)


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's numbers, without zeros, as big-endian bytes."""
    full = rows != 0
    raw = np.ascontiguousarray(rows.astype(">i8")).view(np.uint8).reshape(*rows.shape, 8)[..., 8 - ID_BYTES :][full]
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum(full.sum(axis=1) * ID_BYTES, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _width(pivot: np.ndarray) -> np.ndarray:
    """Bytes of each number of a fragment: none is above the pivot."""
    out = np.ones(len(pivot), dtype=np.int64)
    for k in range(1, ID_BYTES):
        out += pivot >> (8 * k) > 0
    return out


def _bucket(pivot: np.ndarray, part: np.ndarray | int, buckets: int) -> np.ndarray:
    """The partition that a part of a pivot goes to."""
    part = tb.mix(np.asarray(part, dtype=np.uint64).reshape(-1))
    return (tb.mix(pivot.astype(np.uint64) ^ part) % np.uint64(buckets)).astype(np.int64)


def _sent(rows: np.ndarray, counts: np.ndarray, part: np.ndarray, parts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Fragments as a row for each bucket.

    pivots has the bucket's pivots in ``ID_BYTES`` each, runs how many fragments each has in two (a pivot with more
    than ``TOGETHER`` stands there again); sides a byte for each fragment, 16 times the words to the left plus those to the
    right, and 128 if its pivot has several parts; words the numbers without the pivot, each as wide as the
    pivot; times how often it occurs, a byte for each fragment, or four.
    """
    bucket = _bucket(rows[:, SIDE], part, buckets)
    order = np.lexsort((rows[:, SIDE], bucket))
    rows, counts, parts, bucket = rows[order], counts[order], parts[order], bucket[order]
    pivot = rows[:, SIDE].copy()
    at = np.arange(len(rows))
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (pivot[1:] != pivot[:-1]) | (bucket[1:] != bucket[:-1])
    begin = at[new]
    new |= (at - np.repeat(begin, np.diff(np.append(begin, len(rows))))) % TOGETHER == 0
    run = np.flatnonzero(new)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    edges = np.append(begin, len(rows))
    left, right = (rows[:, :SIDE] > 0).sum(axis=1), (rows[:, SIDE + 1 :] > 0).sum(axis=1)
    sides = (left * 16 + right + 128 * (parts > 1)).astype(np.uint8)
    rows[:, SIDE] = 0
    full, width = rows != 0, _width(pivot)
    raw = rows[full].astype(">i8").view(np.uint8).reshape(-1, 8)
    words = raw[np.arange(8) >= 8 - np.repeat(width, left + right)[:, None]]
    wordy = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum((left + right) * width, out=wordy[1:])
    size = np.repeat(np.where(np.maximum.reduceat(counts, begin) > 255, 4, 1), np.diff(edges))
    times = counts.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    timed = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(size, out=timed[1:])
    runs = np.searchsorted(run, edges)

    def column(offsets, data):
        return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    pivots = np.ascontiguousarray(pivot[run].astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - ID_BYTES :])
    lengths = np.diff(np.append(run, len(rows))).astype("<u2").view(np.uint8)
    columns = [pa.array(bucket[begin]), column(runs * ID_BYTES, pivots), column(runs * 2, lengths), column(edges, sides), column(wordy[edges], words), column(timed[edges], times)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "pivots", "runs", "sides", "words", "times"])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a binary column, and where each row begins in them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _received(pivots: pa.Array, runs: pa.Array, sides: pa.Array, words: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments as rows of nine numbers, the pivot in the middle, 0 where there is none; their counts; and the pivots that have several parts."""
    raw = _bytes(pivots)[0].reshape(-1, ID_BYTES)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 8 - ID_BYTES :] = raw
    lengths = np.ascontiguousarray(_bytes(runs)[0]).view("<u2").astype(np.int64)
    pivot = np.repeat(wide.view(">i8").ravel().astype(np.int64), lengths)
    side, at = _bytes(sides)
    n = np.diff(at)
    many = np.unique(pivot[side >= 128])
    left, right = (side >> 4 & 7).astype(np.int64), (side & 15).astype(np.int64)
    out = np.zeros((len(side), 2 * SIDE + 1), dtype=np.int64)
    out[:, SIDE] = pivot
    lens = left + right
    first = np.cumsum(lens) - lens
    row = np.repeat(np.arange(len(side)), lens)
    place = SIDE - left[row] + np.arange(len(row)) - first[row]
    place += place >= SIDE
    width = _width(pivot)[row]
    data, _ = _bytes(words)
    begin = np.cumsum(width) - width
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        value = np.zeros(len(mine), dtype=np.int64)
        for k in range(w):
            value = value << 8 | data[begin[mine] + k]
        out[row[mine], place[mine]] = value
    data, at = _bytes(counts)
    size = np.repeat(np.diff(at) // np.maximum(n, 1), n)
    begin = np.cumsum(size) - size
    times = data[begin].astype(np.int64)
    mine = np.flatnonzero(size == 4)
    for k in range(1, 4):
        times[mine] |= data[begin[mine] + k].astype(np.int64) << (8 * k)
    return out, times, many


def rewritten(words: np.ndarray) -> np.ndarray:
    """The fragment around each word, as far as no word is rarer, as a row of nine; words without company have none.

    words: numbers of frequent words in their order, 0 for all else. To the left of the middle all words are more
    frequent than it, so the middle is the first of the rarest.
    """
    padded = np.concatenate([np.zeros(SIDE, dtype=np.int64), words, np.zeros(SIDE, dtype=np.int64)])
    pivots = np.flatnonzero(words)
    pivot = words[pivots]
    out = np.zeros((len(pivots), 2 * SIDE + 1), dtype=np.int64)
    out[:, SIDE] = pivot
    for way in (-1, 1):
        reach = np.ones(len(pivots), dtype=bool)
        for k in range(1, SIDE + 1):
            near = padded[pivots + SIDE + way * k]
            reach &= (near > 0) & ((near < pivot) if way < 0 else (near <= pivot))
            out[:, SIDE + way * k] = np.where(reach, near, 0)
    return out[(out[:, SIDE - 1] > 0) | (out[:, SIDE + 1] > 0)]


def fragments(blocks: DataFrame, buckets: int, split: int = SPLIT) -> DataFrame:
    """The fragments of the blocks, as ``_sent`` packs them. blocks: order; local and ids, the frequent words' numbers in the block and in all; hot, id and f of those that are frequent enough for several parts."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                order = _long(batch.column(0)[k].as_buffer())
                local, ids = (batch.column(x)[k].values.to_numpy() for x in (1, 2))
                table = np.zeros(int(order.max()) + 1, dtype=np.int64)
                table[local] = ids
                rows = rewritten(table[order])
                if not len(rows):
                    continue
                rows, counts = _merged(rows, np.ones(len(rows), dtype=np.int64))
                pivot = rows[:, SIDE]
                parts = np.ones(len(rows), dtype=np.int64)
                for one in batch.column(3)[k].as_py():
                    parts[pivot == one["id"]] += one["f"] // split
                salt = tb.mix(rows[:, SIDE - 1].astype(np.uint64) ^ tb.mix(rows[:, SIDE + 1].astype(np.uint64) ^ tb.mix(rows[:, SIDE + 2].astype(np.uint64))))
                yield _sent(rows, counts, salt % parts.astype(np.uint64), parts, buckets)

    return blocks.mapInArrow(lean(run), "bucket long, pivots binary, runs binary, sides binary, words binary, times binary")


def phrases_of(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of two words or more around the middle of each fragment, as rows of five, and how often they occur."""
    found, times = [np.zeros((0, MAX_WORDS), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a in range(SIDE + 1):
        for b in range(SIDE, min(2 * SIDE, a + SIDE) + 1):
            if b == a:
                continue
            at = np.flatnonzero((rows[:, a] > 0) & (rows[:, b] > 0))
            part = np.zeros((len(at), MAX_WORDS), dtype=np.int64)
            part[:, : b - a + 1] = rows[at, a : b + 1]
            found.append(part)
            times.append(counts[at])
    return _merged(np.concatenate(found), np.concatenate(times))


def mined(pieces: DataFrame, buckets: int, min_count: int = MIN_COUNT) -> DataFrame:
    """key (the words' numbers), and n, of the phrases that a partition owns and that are frequent.

    Of a word with several parts all phrases come, from each of them; they are still to be added up. The
    phrases of a bucket are held until its last fragment has passed.
    """

    def run(batches):
        held, times = np.zeros((0, MAX_WORDS), dtype=np.int64), np.zeros(0, dtype=np.int64)
        waiting, n, last = [], 0, -1

        def mine(over: bool):
            nonlocal held, times, waiting, n
            many = np.zeros(0, dtype=np.int64)
            if waiting:
                own, counts = phrases_of(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
                held, times = _merged(np.concatenate([held, own]), np.concatenate([times, counts]))
                many = np.unique(np.concatenate([w[2] for w in waiting]))
            # a phrase's rarest word is its pivot
            pivot = held.max(axis=1, initial=0)
            shared = np.isin(pivot, many)
            gone = np.ones(len(held), dtype=bool) if over else shared | (_bucket(pivot, 0, buckets) != last)
            kept = gone & (shared | (times >= min_count))
            out = pa.RecordBatch.from_arrays([_packed(held[kept]), pa.array(times[kept])], names=["key", "n"])
            held, times, waiting, n = held[~gone], times[~gone], [], 0
            return out

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            _, at = _bytes(batch.column(3))
            lo = 0
            while lo < len(batch):
                # rows of so many fragments, and one row at least
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + FRAGMENTS - n, side="right")) - 1)
                waiting.append(_received(*batch.slice(lo, hi - lo).columns[1:]))
                n, last, lo = n + int(at[hi] - at[lo]), int(bucket[hi - 1]), hi
                if n >= FRAGMENTS:
                    yield mine(False)
        yield mine(True)

    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "key binary, n long")


def candidates(docs: DataFrame, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES, split: int = SPLIT, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The frequent words (key, lang, word, f and n, the words of the language), and the phrases with their counts (key, m words, a). From lang and text."""
    spark, paths, passed = docs.sparkSession, [] if paths is None else paths, []
    blocks = written(word_blocks(docs, block_bytes), "word-blocks", passed)
    words = blocks.where("local > 0")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals", passed)
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    often = numbered(often, "frequent", F.desc("f"), "lang", "word", paths=passed).withColumn("id", F.col("nth") + 1)
    # merged at any size, so that a small corpus takes no other way than a large one; infrequent words come along without a number,
    # so that the rows of the join are those of the blocks, and not ever more of them as more words become frequent
    ids = words.join(often.select("lang", "word", "id", "f").hint("merge"), ["lang", "word"], "left")
    # two lists of one aggregation are in one order; a list has no nulls
    hot = F.collect_list(F.when(F.col("f") >= split, F.struct("id", "f")))
    local = F.collect_list(F.when(F.col("id").isNotNull(), F.col("local")))
    known = ids.groupBy("block").agg(local.alias("local"), F.collect_list("id").alias("ids"), hot.alias("hot")).where(F.size("ids") > 0)
    orders = blocks.where("local = 0").select("block", "order").join(known, "block").select("order", "local", "ids", "hot")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-int(n_words) // BUCKET_WORDS))
    found = mined(fragments(orders, buckets, split), buckets, min_count).groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    found = written(found.select("key", (F.length("key") / ID_BYTES).cast("int").alias("m"), "a"), "phrases", paths)
    key = F.unhex(F.lpad(F.hex("id"), 2 * ID_BYTES, "0")).alias("key")
    often = written(often.join(sent_whole(totals, totals.count(), 64), "lang").select(key, "lang", "word", "f", "n"), "frequent-words", paths)
    discard(spark, passed)
    return often, found


def _words(key, start, count):
    """The numbers of ``count`` words of a key from the one numbered ``start`` on."""
    return F.substring(key, 1 + ID_BYTES * start, ID_BYTES * count)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, top: int = TOP, block_bytes: int = BLOCK_BYTES, split: int = SPLIT) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (the counts of the parts of its weakest cut), n (all words) and score.

    A phrase of 2 to 5 words is a candidate if it occurs ``min_count`` times. Its score is 1000 a n / (l r),
    rounded down, at the cut where that is least. A candidate that occurs only inside of a longer one is left out.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    often, found = candidates(rows, min_count, block_bytes, split)
    key, m = F.col("key"), F.col("m")
    # what lies in a longer candidate that is as frequent lies in one that is longer by a word and as frequent
    inside = found.where("m > 2").select(F.explode(F.array(_words(key, F.lit(0), m - 1), _words(key, F.lit(1), m - 1))).alias("key"), F.col("a").alias("longer"))
    inside = inside.groupBy("key").agg(F.max("longer").alias("longer"))
    left = found.join(inside, "key", "left").where("longer IS NULL OR longer < a").select("key", "m", "a")
    counts = found.select("key", F.col("a").alias("f")).unionAll(often.select("key", "f"))
    cuts = left.select("key", "a", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"), "m")
    cuts = cuts.select("key", "a", "k", _words(key, F.lit(0), F.col("k")).alias("__l"), _words(key, F.col("k"), m - F.col("k")).alias("__r"), _words(key, F.lit(0), F.lit(1)).alias("__first"))
    cuts = cuts.join(counts.select(F.col("key").alias("__l"), F.col("f").alias("l")), "__l").join(counts.select(F.col("key").alias("__r"), F.col("f").alias("r")), "__r")
    cuts = cuts.join(often.select(F.col("key").alias("__first"), "lang", "n"), "__first")
    # a product of three counts may pass 64 bits; 38 digits hold it
    big = lambda x: F.col(x).cast("decimal(38,0)")
    cuts = cuts.select("key", "a", "lang", "n", "k", "l", "r", (F.lit(1000).cast("decimal(38,0)") * big("a") * big("n")).alias("__up"), (big("l") * big("r")).alias("__down"))
    cuts = cuts.withColumn("score", F.expr("__up div __down"))
    least = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "lang", "n", "a")).alias("c")).select("key", "c.*")
    # the first of each share of a language, then the first of those; what ties with the last stays until the words are there
    best = [F.desc("score"), F.desc("a")]
    for by in (["lang", F.pmod(F.xxhash64("key"), F.lit(64))], ["lang"]):
        least = least.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("__rank") <= top).drop("__rank")
    spelt = least.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("key") / ID_BYTES).cast("int") - 1), lambda i: _words(key, i, F.lit(1)))).alias("pos", "__word"))
    spelt = spelt.join(often.select(F.col("key").alias("__word"), "word"), "__word").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    spelt = spelt.select("key", F.array_join(F.transform("w", lambda w: w["word"]), " ").alias("phrase"))
    out = least.join(spelt, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long"))
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "lang", "text"))


def oracle_sql(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    return rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, * FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), w AS (
  SELECT lang, p, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)
), seq AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM w WINDOW o AS (PARTITION BY p ORDER BY i)
), grams AS (
  SELECT lang, 1 AS m, [w1] AS g, count(*) AS f FROM seq GROUP BY ALL
  UNION ALL SELECT lang, 2, [w1, w2], count(*) FROM seq WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {min_count}
  UNION ALL SELECT lang, 3, [w1, w2, w3], count(*) FROM seq WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {min_count}
  UNION ALL SELECT lang, 4, [w1, w2, w3, w4], count(*) FROM seq WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {min_count}
  UNION ALL SELECT lang, 5, [w1, w2, w3, w4, w5], count(*) FROM seq WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= {min_count}
), total AS (
  SELECT lang, sum(f) AS n FROM grams WHERE m = 1 GROUP BY lang
), inside AS (
  SELECT DISTINCT a.lang, a.g[i : i + k - 1] AS g, a.f
  FROM (SELECT *, unnest(range(2, m)) AS k FROM grams WHERE m > 2) a, LATERAL (SELECT unnest(range(1, a.m - a.k + 2)) AS i)
), maximal AS (
  SELECT c.* FROM grams c
  WHERE c.m >= 2 AND NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.g = c.g AND 100 * x.f >= 100 * c.f)
), cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, t.n, l.f AS l, r.f AS r, 1000::HUGEINT * c.f::HUGEINT * t.n::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM maximal) c
  JOIN total t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.g = c.g[: k]
  JOIN grams r ON r.lang = c.lang AND r.g = c.g[k + 1 :]
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM least
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {top}
"""


ORACLE_SQL = oracle_sql()
