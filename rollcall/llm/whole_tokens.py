"""Token counts with the whole-token shortcut.

Offline, once, every vocabulary entry is given to the tokenizer alone; those that come
back as one token, itself, are proven. They go to the workers as two numbers each, and
there are no more of them than the vocabulary has entries. A text is cut into units that encode
alike alone and in place (``units.spaced_units``). Units equal to a proven string
count one without being encoded; only the rest is merged by the tokenizer, each
different one once while a bounded memory holds it.

Defined cases: a null text is an empty one and has no tokens. A text with a
special string goes to the tokenizer whole, which counts it as it does by
default. Rows, ids and extra columns don't matter: each row is counted alone.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .runtime import documents, lean
from .units import UnitMemory, encoder, spaced_units, special_strings, texts_with

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512

_loaded: dict = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, once for each process; a bare name is looked for among the public tokenizers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    if path not in _loaded:
        tokenizer = Tokenizer.from_file(path if os.path.sep in path else public_tokenizers.path(path))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def proven_strings(tokenizer) -> dict[str, int]:
    """The vocabulary's strings that the tokenizer encodes alone as the one token that they are."""
    special = {x.content for x in tokenizer.get_added_tokens_decoder().values()}
    n = tokenizer.get_vocab_size(with_added_tokens=False)
    texts = [(tokenizer.decode([i], skip_special_tokens=False), i) for i in range(n)]
    texts = [(t, i) for t, i in texts if t and "�" not in t and t not in special]
    out = tokenizer.encode_batch_fast([t for t, _ in texts], add_special_tokens=False)
    return {t: i for (t, i), e in zip(texts, out) if e.ids == [i]}


def _hashes(strings: list[str]) -> np.ndarray:
    raw = [s.encode() for s in strings]
    lens = np.array([len(x) for x in raw], dtype=np.int64)
    ends = np.cumsum(lens)
    return tb.run_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - lens, ends)


def proof(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the proven strings, and their ids."""
    proven = proven_strings(load_tokenizer(path))
    return _hashes(list(proven)), np.array(list(proven.values()), dtype=np.int32)


class Counter:
    """Counts tokens; one for each worker process, whose memory of units serves all its tasks."""

    def __init__(self, path: str, proven: tuple[np.ndarray, np.ndarray] | None = None):
        self.tokenizer = load_tokenizer(path)
        self.memory = UnitMemory(encoder(self.tokenizer), given=proven or proof(path))
        self.special = special_strings(self.tokenizer)

    def count(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        starts, ends = spaced_units(data, off)
        _, lens, _ = self.memory.look_up(data, starts, ends, tb.run_hashes(data, starts, ends))
        out = np.bincount(tb.text_of(starts, off), weights=lens, minlength=n).astype(np.int64)
        for i in texts_with(data, off, self.special):
            out[i] = len(self.tokenizer.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids)
        return out


_counters: dict[str, Counter] = {}


def _counter(path: str, proven: tuple[np.ndarray, np.ndarray] | None = None) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, proven)
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row."""
    proven = docs.sparkSession.sparkContext.broadcast(proof(tokenizer))

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in tb.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(_counter(tokenizer, proven.value).count(data, off))], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(documents(spark, sf_dir, "doc_id", "text"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
