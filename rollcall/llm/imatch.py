"""I-Match fingerprints over randomised lexicons.

1. In how many documents each term stands is counted over all documents.
2. Terms whose inverse document frequency, log2(documents / frequency), lies within
   the band are the lexicon. A term of the band stands in at least documents /
   2 ** ``IDF_MOST`` documents, so there are at most 2 ** ``IDF_MOST`` times as many
   as a document has distinct terms on average: the lexicon doesn't grow with the
   number of documents. Its size is checked before it is broadcast; one of more than
   ``MAX_TERMS`` terms, which documents of 100,000 distinct terms each may have, is an
   error that asks for a narrower band.
3. The lexicon is cut into ``SUBSETS`` random subsets of several densities. For each
   subset the distinct terms of a document that lie in it are sorted and hashed.
   A fingerprint is the row of these hashes; the likeness of two is the share of
   equal ones among the subsets in which one of the two documents has terms.

Sparse subsets still agree when a part of a text is replaced, dense ones tell
small edits. Defined cases: a null text is an empty one. Terms are runs of letters
and digits, A-Z in lower case. A document without terms of the lexicon (an empty
one too) is fingerprinted by all its bytes instead, and is like another one only
if that is equal. Null ids come first in the order of ids; rows of one id follow
in the order of a hash of their texts. Rows that agree in id and text pass through one
task, one after the other. Of an empty table the result is empty. Other columns are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .runtime import discard, documents, in_order, lean, sortable, written

IDF_LEAST, IDF_MOST = 2.0, 9.0
#: The share of the lexicon in each subset: one over these numbers.
DENSITIES = (1, 4, 16) + (32,) * 4 + (64,) * 8 + (128,) * 16 + (256,) * 16
SUBSETS = len(DENSITIES)
#: Hex digits of a subset's hash; dashes stand for a subset without terms.
DIGITS = 8
#: Bytes of text that a task orders by id, about; each such range is two numbers that are broadcast.
RANGE_BYTES = 16 << 20
#: Terms of a lexicon, at most: a worker holds about 75 bytes for each, the driver 8.
MAX_TERMS = 1 << 23


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text and the hash of each term, in a row."""
    low = tb.lowered(data)
    starts, ends = tb.runs(tb.WORDISH[low], off)
    return tb.text_of(starts, off), tb.run_hashes(low, starts, ends)


def _distinct(text: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((terms, text))
    text, terms = text[order], terms[order]
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != text[:-1]) | (terms[1:] != terms[:-1])
    return text[keep], terms[keep]


def term_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term (its hash) and n_docs. Tasks sum up before the shuffle."""

    def run(batches):
        for batch in batches:
            found = [_distinct(*term_hashes(data, off))[1] for _, _, data, off in tb.slices(batch.column(0))]
            if found:
                terms, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(count)], names=["term", "n"])

    return docs.select(text).mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))


def lexicon(docs: DataFrame, n_docs: int, text: str = "text", least: float = IDF_LEAST, most: float = IDF_MOST) -> np.ndarray:
    """The sorted hashes of the terms in the band; its size is bounded as said above."""
    idf = F.log2(F.lit(n_docs) / F.col("n_docs"))
    paths: list[str] = []
    terms = written(term_frequencies(docs, text).where((idf >= least) & (idf <= most)).select("term"), "lexicon", paths)
    if (n := terms.count()) > MAX_TERMS:
        raise ValueError(f"{n} terms lie in the band, more than {MAX_TERMS}; narrow it")
    rows = terms.toArrow()
    discard(docs.sparkSession, paths)
    return np.sort(rows["term"].to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, dtype=np.uint64)


class Fingerprinter:
    """Fingerprints by a lexicon and its subsets."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        seats, subsets = [], []
        for k, d in enumerate(DENSITIES):
            inside = np.flatnonzero(tb.mix(terms ^ tb.mix(np.array([k + 1], dtype=np.uint64))) % np.uint64(d) == 0)
            seats.append(inside)
            subsets.append(np.full(len(inside), k))
        seat, subset = np.concatenate(seats), np.concatenate(subsets)
        order = np.argsort(seat, kind="stable")
        #: the subsets of each term, one term after the other
        self.subset = subset[order]
        self.count = np.bincount(seat, minlength=len(terms))
        self.begin = np.cumsum(self.count) - self.count

    def hashes(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row of hashes for each text; 0 where a subset has no term."""
        n = len(off) - 1
        out = np.zeros((n, SUBSETS), dtype=np.uint64)
        text, terms = term_hashes(data, off)
        if not len(self.terms) or not len(terms):
            return out
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[place] == terms
        text, place = _distinct(text[hit], place[hit])
        times = self.count[place]
        at = np.cumsum(times) - times
        subset = self.subset[np.arange(int(times.sum())) - np.repeat(at - self.begin[place], times)]
        group = np.repeat(text, times) * SUBSETS + subset
        terms = np.repeat(self.terms[place], times)
        # terms are sorted within a text, and a stable sort keeps them so within a subset
        order = np.argsort(group, kind="stable")
        group, terms = group[order], terms[order]
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
        if len(head):
            # the hash of a sorted row of terms: each counts by its place
            nth = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
            value = np.add.reduceat(tb.mix(terms ^ tb.mix(nth.astype(np.uint64))), head)
            out.ravel()[group[head]] = tb.mix(value) | np.uint64(1)
        return out


def fingerprint_text(row: np.ndarray, raw: bytes) -> str:
    if not row.any():
        return "text-" + hashlib.sha256(raw).hexdigest()
    return "".join(f"{int(x) >> (64 - 4 * DIGITS):0{DIGITS}x}" if x else "-" * DIGITS for x in row)


def likeness(a: np.ndarray, b: np.ndarray, same_text: np.ndarray) -> np.ndarray:
    """For rows of hashes, row by row; same_text: whether texts without terms are equal."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either > 0, equal / np.maximum(either, 1), same_text.astype(float))


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many first characters of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def range_starts(docs: DataFrame, n_bytes: int, range_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The first key and tie of each range of about so many bytes, in order."""

    def run(batches):
        total, current, last = 0, -1, None
        for batch in batches:
            key, tie, size = (batch.column(k).to_numpy() for k in range(3))
            if not len(key):
                continue
            before = total + np.cumsum(size) - size
            total = int(before[-1] + size[-1])
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])
            fresh[0] = (key[0], tie[0]) != last
            last = (key[-1], tie[-1])
            heads = np.flatnonzero(fresh)
            nth = before[heads] // range_bytes
            begins = np.diff(nth, prepend=current) > 0
            if len(heads):
                current = int(nth[-1])
            at = heads[begins]
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(tie[at])], names=["key", "tie"])

    sizes = docs.select("key", "tie", (F.octet_length("text") + 16).cast("long").alias("size"))
    rows = in_order(sizes, n_bytes, "key", "tie").mapInArrow(lean(run), "key long, tie long").toArrow()
    key, tie = (rows[x].to_numpy() if rows.num_rows else np.zeros(0, dtype=np.int64) for x in ("key", "tie"))
    order = np.lexsort((tie, key))
    return key[order], tie[order]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = IDF_LEAST, most: float = IDF_MOST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    Texts are dealt out by ranges of ids, once; the first document of each range
    also goes to the range before it. A range's documents pass in order, and of
    each only the one before it is kept.
    """
    least_key = -(1 << 63)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(least_key))).withColumn("tie", F.xxhash64("text"))
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, n_docs, "text", least, most))
    starts = sortable(*range_starts(docs, n_bytes, range_bytes))
    table = docs.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        """The range of a document, and the range before if it is the first of its own; after the last range the first one comes."""
        starts = table.value
        own = sortable(key.to_numpy(), tie.to_numpy())
        r = np.searchsorted(starts, own, side="right") - 1
        first = starts[r] == own
        return pd.Series([[a, (a or len(starts)) - 1] if f else [a] for a, f in zip(r.tolist(), first.tolist())])

    # the first place is a document's own, others need it as the one that follows
    dealt = docs.select("doc_id", "key", "tie", "text", F.posexplode(ranges_of("key", "tie")).alias("guest", "r"))
    dealt = dealt.select("r", "guest", "doc_id", "key", "text", "tie")
    # as many partitions as ranges: a task's share doesn't grow with the corpus
    dealt = dealt.repartition(max(1, len(starts)), "r").sortWithinPartitions("r", "guest", "key", "tie").select("r", "guest", "doc_id", "key", "text")

    def run(batches):
        prints = Fingerprinter(terms.value)
        before = None  # (range, id, text) of the last document that still lacks the next one
        ready: list[tuple] = []
        size = 0

        def close(ready):
            ids, own, after, changed = [x[0] for x in ready], [x[1] for x in ready], [x[2] for x in ready], []
            changed = [edited(a, b) for a, b in zip(own, after)]
            # a text that follows is mostly the next one's own
            columns = []
            for texts in (own, changed, after[-1:]):
                columns.append(np.concatenate([prints.hashes(d, o) for _, _, d, o in tb.slices(pa.array(texts, pa.large_string()))]))
            mine, other, last = columns
            follows = np.concatenate([mine[1:], last])
            for k in [k for k in range(len(ready) - 1) if after[k] is not own[k + 1]]:
                follows[k] = np.concatenate([prints.hashes(d, o) for _, _, d, o in tb.slices(pa.array([after[k]], pa.large_string()))])[0]
            raw, raw_changed = [x.encode() for x in own], [x.encode() for x in changed]
            same_changed = np.array([a == b for a, b in zip(own, changed)])
            same_next = np.array([a == b for a, b in zip(own, after)])
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw_changed]),
                pa.array([fingerprint_text(h, x) for h, x in zip(mine, raw)]), pa.array([fingerprint_text(h, x) for h, x in zip(other, raw_changed)]),
                pa.array(likeness(mine, other, same_changed)), pa.array(likeness(mine, follows, same_next)),
            ], names=NAMES)

        for batch in batches:
            for r, guest, doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if before is not None and before[0] == r:
                    ready.append((before[1], before[2], body))
                    size += len(before[2])
                    before = None
                if not guest:
                    before = (r, doc_id, body)
                if size >= tb.SLICE_BYTES:
                    yield close(ready)
                    ready, size = [], 0
        if ready:
            yield close(ready)

    return dealt.mapInArrow(lean(run), SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir, "doc_id", "text"))
