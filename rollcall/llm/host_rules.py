"""Quality rules judged by host.

Each document gets five counts and a base verdict. Failures are then summed by
host, each host's failure rate is shrunk towards the mean of all hosts by a
beta prior, and the verdict on the host is joined back to its documents. A document is
kept if it passes the base rules and the shrunk rate of its host is at most ``max_rate``.

The prior is fitted to the hosts' rates by the method of moments. The variance of observed
rates is that of the hosts' own rates, v, and the noise of counting few documents, which is
(m (1 - m) - v) / n for a host of n documents, on average; the prior takes v alone, so many small
hosts make it neither weak nor strong.

Defined cases: a null or empty text has no words and fails. A null host is a
host of its own. Repeated rows count as often as they stand there. Of an empty
table the result is empty. Input columns named like a result column, in upper or lower
case, give way; other names don't matter. If the hosts' rates differ by no more than
counting explains, or no host has a second document, the prior has weight ``MAX_WEIGHT``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .runtime import documents, lean, row_columns, row_of, schema_with, written

SYMBOLS = tb.byte_set(b"#*$%&|<>")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected if its shrunk failure rate is above this.
MAX_RATE = 0.5
#: Bounds of the prior's weight, in documents.
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1e6

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    n = len(off) - 1
    in_word = ~tb.SPACE[data]
    starts, ends = tb.runs(in_word, off)
    text = tb.text_of(starts, off)
    out = {
        "n_words": tb.count_by_text(text, n),
        "word_chars": tb.sums_by_text(in_word & ((data & 0xC0) != 0x80), off),
        "n_symbols": tb.sums_by_text(SYMBOLS[data], off),
    }
    a, b = tb.runs(data != 10, off)
    words = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(in_word, out=words[1:])
    full = words[b] > words[a]
    a, b = a[full], b[full]
    of = tb.text_of(a, off)
    keys = np.sort(tb.mix(tb.run_hashes(data, a, b) ^ tb.mix(of.astype(np.uint64))))
    distinct = np.ones(len(keys), dtype=bool)
    distinct[1:] = keys[1:] != keys[:-1]
    lines = tb.count_by_text(of, n)
    if distinct.all():
        out["n_dup_lines"] = np.zeros(n, dtype=np.int64)
    else:
        by_text = tb.mix(tb.run_hashes(data, a, b) ^ tb.mix(of.astype(np.uint64)))
        _, first = np.unique(by_text, return_index=True)
        out["n_dup_lines"] = lines - tb.count_by_text(of[first], n)
    window, begin = tb.windows(tb.run_hashes(data, starts, ends), text, WINDOW)
    key = tb.mix(window ^ tb.mix(text[begin].astype(np.uint64)))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeated = np.zeros(n, dtype=np.int64)
    if len(twice):
        at = np.searchsorted(twice, key)
        hit = begin[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == key)]
        edge = np.bincount(hit, minlength=len(text) + 1) - np.bincount(hit + WINDOW, minlength=len(text) + 1)[: len(text) + 1]
        repeated = tb.count_by_text(text[np.cumsum(edge)[: len(text)] > 0], n)
    out["n_repeat_words"] = repeated
    return out


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the five counts, and base_failed."""
    new = [*COUNTS, "base_failed"]
    rows = docs.select(row_of(docs, *new), F.col(text).alias("__text"))
    schema = schema_with(rows, [T.StructField(x, T.LongType()) for x in COUNTS] + [T.StructField("base_failed", T.BooleanType())])

    def run(batches):
        for batch in batches:
            parts = [text_counts(data, off) for _, _, data, off in tb.slices(batch.column(1))]
            found = {x: np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for x in COUNTS}
            failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
            yield tb.with_columns(batch, {k: pa.array(v) for k, v in found.items()} | {"base_failed": pa.array(failed)})

    return rows.mapInArrow(lean(run), schema).select(*row_columns(docs, *new), *new)


def host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate and host_failed, a row for each host."""
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("seen"), F.avg(1 / F.col("n_docs")).alias("few"))
    own = (F.col("seen") - F.col("m") * (1 - F.col("m")) * F.col("few")) / (1 - F.col("few"))
    prior = prior.select("m", F.when(F.col("few") < 1, own).otherwise(0.0).alias("v"))
    weight = F.when(F.col("v") > 0, F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(MAX_WEIGHT))
    # two numbers, as a scalar subquery
    prior = prior.select(F.struct("m", weight.alias("w")).alias("p")).scalar()
    hosts = hosts.withColumn("p", prior)
    shrunk = (F.col("n_failed") + F.col("p.m") * F.col("p.w")) / (F.col("n_docs") + F.col("p.w"))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > max_rate).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` without its text, with the counts, base_failed, shrunk_rate, host_failed and kept."""
    new = [*COUNTS, "base_failed", "shrunk_rate", "host_failed", "kept"]
    rows = docs.select(F.struct(row_of(docs, text, *new), F.col(host).alias("host")).alias("__given"), F.col(text).alias("__text"))
    judged = written(with_counts(rows, "__text").drop("__text").select("__given.*", *COUNTS, "base_failed"), "counts")
    verdicts = written(host_verdicts(judged, "host", max_rate), "hosts").select(F.col("host").alias("of"), "shrunk_rate", "host_failed")
    out = judged.join(verdicts, judged["host"].eqNullSafe(verdicts["of"]), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
    return out.select(*row_columns(docs, text, *new), *COUNTS, "base_failed", "shrunk_rate", "host_failed", kept.alias("kept"))


def filter_documents(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``.

    Texts are read and measured once: what passes the base rules is written with
    its host's key while the failures are summed.
    """
    rows = docs.select(F.struct(row_of(docs), F.col(host).alias("host")).alias("__given"), F.col(text).alias("__text"))
    judged = with_counts(rows, "__text").select(F.when(~F.col("base_failed"), F.col("__given.__row")).alias("__row"), "__given.host", "base_failed")
    judged = written(judged, "passed")
    bad = written(host_verdicts(judged.select("host", "base_failed"), "host", max_rate).where("host_failed").select(F.col("host").alias("bad")), "bad-hosts")
    kept = judged.where(~F.col("base_failed")).join(bad, judged["host"].eqNullSafe(bad["bad"]), "left_anti")
    return kept.select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", F.coalesce("host_failed", F.lit(False)).alias("host_failed"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT row_number() OVER () AS rid, * FROM d
), win AS (
  SELECT rid, i, w[i : i + {WINDOW - 1}] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM l WHERE len(w) >= {WINDOW})
), rep AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1)
  GROUP BY rid
), ln AS (
  SELECT rid, count(*) - count(DISTINCT x) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM l)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
  GROUP BY rid
), c AS (
  SELECT l.rid, doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source
), p AS (
  SELECT m, CASE WHEN v > 0 THEN greatest({MIN_WEIGHT}, least({MAX_WEIGHT}, m * (1 - m) / v - 1)) ELSE {MAX_WEIGHT} END AS k
  FROM (SELECT m, CASE WHEN few < 1 THEN (seen - m * (1 - m) * few) / (1 - few) ELSE 0 END AS v FROM (SELECT avg(f / n) AS m, var_pop(f / n) AS seen, avg(1 / n) AS few FROM h))
), j AS (
  SELECT source AS host, (f + m * k) / (n + k) > {MAX_RATE} AS host_failed FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept, host_failed
FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.host
"""
