"""Mixing sources to target weights by Pfair scheduling.

1. The documents of a source, in a random but fixed order, are one stream of bytes,
   cut into blocks of ``block_bytes``; a document belongs to the block in which it
   begins. Streams are laid out over buckets of (source, hash), so a large source
   is many small groups.
2. In a fluid schedule all sources flow side by side, each at its weight over the
   sum of the weights of those that have blocks left. By slot t a source has had
   S(t) blocks; where a source ends, the others flow faster from that very point on,
   and the sum of all S(t) always is t. A source's i-th block (from 1) is released
   in the slot in which S passes i - 1 and due at the end of that in which it reaches i.
   In each slot, of the released blocks the one with the earliest deadline goes.
   So no source ever is a whole block ahead of or behind its S(t), ends of other
   sources included: as many blocks as S(t) holds in full are due by t, and none is
   released before S reaches it; the fluid schedule shows that all deadlines can be met,
   and the earliest deadline first meets them if any order does.
3. Slots are found in stretches of ``stretch`` slots, side by side. What has gone
   before a stretch isn't simulated from the start: blocks in flight at slot t are
   those that S(t) holds in part, and which of them went before t depends only on
   what came after the earliest of their releases. So each stretch begins there, and goes
   through the slots up to its own without keeping them: where a block of a very light source
   is in flight for longer than a stretch, later stretches take longer, and no more memory.
4. Slots are joined back to documents.

All documents are kept, each once. A task of the schedule holds the blocks of as many
slots as its stretch has, those in flight, at most one or two a source, and three numbers and the name of each
source that still flows; no task holds all blocks. Without given weights, a source
weighs its bytes to the power ``TEMPERATURE``. Weights are rounded to millionths of the largest
(``PARTS``), and a smaller one counts as a millionth. Defined cases: a null source is a source
of its own. A null text has no bytes and still counts ``ROW_BYTES``. A source without a
given weight gets the smallest given one. Rows that agree in id and text follow one
another. Of an empty table the result is empty. Extra columns pass through ``mixed``
whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prefix_tree import _spread
from .runtime import documents, in_order, passing, row_of, summed_before, written

BLOCK_BYTES = 1 << 20
ROW_BYTES = 16
TEMPERATURE = 0.5
#: Rows of a bucket, about.
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 64
#: Weights are rounded to whole parts of this.
PARTS = 1_000_000
#: Slots of a stretch.
STRETCH = 100_000


class Fluid:
    """The fluid schedule of sources of whole weights and blocks, as far as they end after the first ``base`` slots' sources did.

    weights and blocks belong to the sources that haven't ended; base is the number
    of all blocks of those that have. Numbers are exact: they are integers, in Python's
    own arithmetic where 64 bits may not do.
    """

    def __init__(self, weights: list[int], blocks: list[int], base: int = 0):
        most = (base + sum(blocks)) * max(sum(weights), 1)
        self.kind = np.int64 if most < 1 << 62 else object
        self.w, self.n = np.array(weights, dtype=self.kind), np.array(blocks, dtype=self.kind)
        # a source ends when the flow for each part of weight reaches blocks / weight
        order = sorted(range(len(weights)), key=_Ratio.of(blocks, weights))
        self.end_w, self.end_n = self.w[order], self.n[order]
        self.end_at = np.array([n / w for n, w in zip(self.end_n.tolist(), self.end_w.tolist())], dtype=np.float64)
        #: blocks of the ended sources, and weights of the others, by how many have ended
        self.gone = np.concatenate([[0], np.cumsum(self.end_n)]).astype(self.kind) + base
        self.left = sum(weights) - np.concatenate([[0], np.cumsum(self.end_w)]).astype(self.kind)
        self.base, self.total = base, base + sum(blocks)

    def _ended(self, i: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How many sources have ended when the flow reaches i / w."""
        m = len(self.end_w)
        j = np.searchsorted(self.end_at, i.astype(np.float64) / w.astype(np.float64), side="right")
        while True:  # floating point may be off by a little
            k = np.minimum(j, m - 1)
            up = (j < m) & (self.end_n[k] * w <= i * self.end_w[k])
            k = np.maximum(j - 1, 0)
            down = (j > 0) & (self.end_n[k] * w > i * self.end_w[k])
            if not (up.any() or down.any()):
                return j
            j = j + up.astype(np.int64) - (down & ~up).astype(np.int64)

    def slot_of(self, i: np.ndarray, w: np.ndarray, up: bool) -> np.ndarray:
        """The time at which the flow of a source of weight w reaches i blocks, rounded to a slot."""
        j = self._ended(i, w)
        flow = i * self.left[j]
        return self.gone[j] + (-(-flow // w) if up else flow // w)

    def whole(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """For each source the whole blocks that it has had by slot t, and whether it has part of another one."""
        if t >= self.total:
            return self.n, np.zeros(len(self.n), dtype=bool)
        # the phase of t: the sources that ended by then
        j, m = 0, len(self.end_w)
        low, high = 0, m
        while low < high:
            j = (low + high) // 2
            if (t - int(self.gone[j])) * int(self.end_w[j]) >= int(self.end_n[j]) * int(self.left[j]):
                low = j + 1
            else:
                high = j
        flow, over = t - int(self.gone[low]), int(self.left[low])
        had = self.w * flow
        ended = np.array(self.n * over <= had, dtype=bool)
        return np.where(ended, self.n, had // over), ~ended & np.array(had % over != 0, dtype=bool)


class _Ratio:
    """Compares blocks / weight exactly."""

    __slots__ = ("a", "b")

    def __init__(self, a: int, b: int):
        self.a, self.b = int(a), int(b)

    def __lt__(self, other: _Ratio) -> bool:
        return self.a * other.b < other.a * self.b

    @classmethod
    def of(cls, a: list[int], b: list[int]):
        return lambda i: cls(a[i], b[i])


def schedule(weights: list[int], blocks: list[int], start: int = 0, stop: int | None = None, base: int = 0, step: int = STRETCH, held: list[int] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of the slots from ``start`` up to ``stop``, in their order.

    A block goes at or after its release and before its deadline. Sources of which
    no block is in flight at ``start`` or later may be left out if ``base`` says how many
    blocks the ones left out have that ended first. The blocks of ``step`` slots are
    held at a time, and those in flight; their number is added to ``held``.
    """
    if not weights:
        return
    fluid = Fluid(weights, blocks, base)
    stop = fluid.total if stop is None else min(stop, fluid.total)
    if start >= stop:
        return
    # where the simulation begins: the earliest release of what is in flight at the start
    had, part = fluid.whole(start)
    begin = start
    if part.any():
        begin = int(fluid.slot_of(had[part], fluid.w[part], False).min())
    ready: list[tuple[int, int, int, int]] = []
    # what is in flight at the beginning
    had, part = fluid.whole(begin)
    source = np.flatnonzero(part)
    block, w = had[source], fluid.w[source]
    flying = list(zip(fluid.slot_of(block + 1, w, True).tolist(), source.tolist(), block.tolist(), fluid.slot_of(block, w, False).tolist()))
    flying = sorted(x for x in flying if x[3] < begin)
    # so many of those have gone before; that those with late deadlines wait is as good as any case
    wait = len(flying) - (begin - base - int(had.sum()))
    ready = flying[len(flying) - wait :] if wait else []
    heapq.heapify(ready)
    seen = had + np.array(part, dtype=fluid.kind)
    for at in range(begin, stop, step):
        # the blocks that are released in the next slots
        upto = min(at + step, stop)
        had, part = fluid.whole(upto)
        now = had + np.array(part, dtype=fluid.kind)
        count = (now - seen).astype(np.int64)
        source = np.repeat(np.arange(len(blocks)), count)
        block = _spread(seen.astype(np.int64), count).astype(fluid.kind)
        w = fluid.w[source]
        release, deadline = fluid.slot_of(block, w, False), fluid.slot_of(block + 1, w, True)
        order = np.argsort(release.astype(np.int64), kind="stable")
        jobs = list(zip(deadline[order].tolist(), source[order].tolist(), block[order].tolist(), release[order].tolist()))
        seen, k = now, 0
        if held is not None:
            held.append(len(jobs) + len(ready))
        for slot in range(at, upto):
            while k < len(jobs) and jobs[k][3] <= slot:
                heapq.heappush(ready, jobs[k])
                k += 1
            due, s, i, released = heapq.heappop(ready)
            if slot >= start:
                yield s, i, released, due, slot


def _streams(docs: DataFrame, source: str, id_col: str, text: str) -> DataFrame:
    """source, doc_id, tie, before (bytes of the source's documents before this one)."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    rows = docs.select(F.col(source).alias("source"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), size.alias("size"))
    rows = written(rows.withColumn("order", F.xxhash64("doc_id", "tie")), "mix-rows")
    buckets = LEAST_BUCKETS + rows.count() // BUCKET_ROWS
    rows = rows.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bytes"))
    # a row for each BUCKET_ROWS rows of a source
    past = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("bytes").over(past), F.lit(0))).select(F.col("source").alias("of"), F.col("bucket").alias("b"), "base")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(sums, rows["source"].eqNullSafe(sums["of"]) & (rows["bucket"] == sums["b"]))
    return joined.select("source", "doc_id", "tie", "size", "order", (F.col("base") + F.col("inside")).alias("before"))


def _weighed(totals: DataFrame, weights: dict[str, float] | None, block_bytes: int) -> DataFrame:
    """source, w (whole parts) and n (blocks) of each source."""
    if weights:
        given = totals.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "name string, given double")
        weight = F.coalesce("given", F.lit(float(min(weights.values()))))
        totals = totals.join(given, F.col("source") == F.col("name"), "left")
    else:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(TEMPERATURE))
    totals = totals.select("source", weight.alias("weight"), F.ceil(F.col("bytes") / block_bytes).cast("long").alias("n"))
    top = totals.agg(F.max("weight")).scalar()
    return totals.select("source", F.greatest(F.lit(1), F.floor(F.lit(PARTS) * F.col("weight") / top + 0.5)).cast("long").alias("w"), "n")


def plan_slots(sources: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """of (the source), at (the block), release, deadline and slot of all blocks, from source, w and n of each source."""
    # by the flow n / w at which each source ends; as weights are at most PARTS, different ratios differ by this much
    sources = sources.withColumn("flow", F.expr("n div w")).withColumn("over", F.expr(f"((n % w) * {PARTS * PARTS}) div w"))
    sources = summed_before(sources, ["flow", "over", "source"], {"gone": "n", "faded": "w"}, "mix-sources")
    total, weight, least = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.min("w"), F.lit(1))).first()
    # no block is in flight for more slots than this
    reach = -(-int(weight) // int(least)) + 2
    stretches = max(1, -(-int(total) // stretch))
    # a source takes part in all stretches that begin before its end or soon after; a little more does no harm
    end = F.col("gone") + F.col("n") + (1 + 1e-9) * F.col("n") * (weight - F.col("faded") - F.col("w")).cast("double") / F.col("w") + 2
    last = F.least(F.lit(stretches - 1), F.floor((end + reach) / stretch)).cast("long")
    parts = sources.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), last))).select("stretch", "source", "w", "n", "gone")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["stretch"].iloc[0])
        group = group.sort_values("source", na_position="first", kind="stable")
        names = [None if x is None or x != x else x for x in group["source"].tolist()]
        out = list(schedule(group["w"].tolist(), group["n"].tolist(), k * stretch, (k + 1) * stretch, int(group["gone"].min()), stretch))
        return pd.DataFrame([(names[r[0]], *r[1:]) for r in out], columns=["of", "at", "release", "deadline", "slot"])

    return parts.groupBy("stretch").applyInPandas(run, "of string, at long, release long, deadline long, slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, source: str = "source", id_col: str = "doc_id", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """source, doc_id, tie (a hash of the text), block, nth (the place in the block), release, deadline and slot of each document."""
    with passing(docs.sparkSession) as keep:
        rows = written(_streams(docs, source, id_col, text), "streams", keep)
        totals = rows.groupBy("source").agg(F.sum("size").alias("bytes"))
        plan = written(plan_slots(_weighed(totals, weights, block_bytes), stretch), "schedule", keep)
    rows = rows.withColumn("block", F.expr(f"before div {block_bytes}"))
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["of"]) & (rows["block"] == plan["at"]))
    nth = F.row_number().over(Window.partitionBy("slot").orderBy("before", "order", "doc_id", "tie"))
    return joined.withColumn("nth", nth.cast("long")).select("source", "doc_id", "tie", "block", "nth", "release", "deadline", "slot")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, source: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in the order of the schedule: files and their rows, once written, stand in that order."""
    least = F.lit(-(1 << 63))
    order = mix(docs, weights, block_bytes, source, id_col, text).select(F.coalesce("doc_id", least).alias("__id"), F.col("tie").alias("__tie"), F.col("slot").alias("__slot"), F.col("nth").alias("__nth"))
    # rows that agree in id and text have one place after another; the first stands for them
    order = order.groupBy("__id", "__tie").agg(F.min(F.struct("__slot", "__nth")).alias("__at"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES), F.lit(0))).first()[0]
    rows = docs.select(row_of(docs), F.coalesce(F.col(id_col).cast("long"), least).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__tie"))
    return in_order(rows.join(order.hint("merge"), ["__id", "__tie"]), n_bytes, "__at", "__id").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).drop("tie")
