import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from rollcall.llm import hilbert_shards as hs
from rollcall.llm import imatch, pfair_mix
from rollcall.llm.runtime import in_byte_order, scratch

from .data import SCHEMA, frame, rows, with_clashes

# Hilbert shards


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    index = hs.hilbert_index(list(cells), bits)
    assert sorted(index) == list(range(1 << (bits * dims)))
    assert (np.abs(np.diff(cells[:, np.argsort(index)], axis=1)).sum(axis=0) == 1).all()


@pytest.mark.parametrize("shards,part_bytes", [(40, 128 << 20), (7, 3000), (1, 1000), (200, 500)])
def test_shards(spark, shards, part_bytes):
    data = rows(n=90)
    folder = scratch(spark, "test-shards")
    odd = with_clashes(frame(spark, data), "Shard", "slot", "__id", "__row", "at", "part", "rank", "a.b")
    read = hs.write_shards(odd, folder, shards=shards, part_bytes=part_bytes)
    assert [c for c in read.columns if c.lower() in ("shard", "slot")] == ["slot", "shard"] and "a.b" in read.columns
    out = read.collect()
    key = lambda r: str((r["doc_id"], r["text"], r["source"]))
    assert sorted(map(key, out)) == sorted(str((d, t, s)) for d, t, _, s, _ in data)
    count = Counter(r["shard"] for r in out)
    assert set(count) <= set(range(shards)) and len(count) == min(shards, len(data))
    assert max(count.values()) - (min(count.values()) if len(data) >= shards else 0) <= 1
    for s in count:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(count[s]))
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in out)


@pytest.mark.parametrize("part_bytes", [700, 5000, 1 << 20])
def test_ranges_hold_equal_bytes(spark, part_bytes):
    """Rows whose size goes with the key, and many rows of one key: no range holds more than asked for and a row."""
    data = [(k // 40, -5 if k > 200 else k, 1 + k // 2) for k in range(400)] + [(-7, 1, 3000), (2**62, -(2**63), 9)]
    df = spark.createDataFrame(data, "a long, b long, n int").withColumn("c", hs.F.monotonically_increasing_id()).repartition(5)
    out = in_byte_order(df, len(data), hs.F.col("n"), "a", "b", "c", part_bytes=part_bytes)
    got = out.withColumn("part", hs.F.spark_partition_id()).collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == sorted((r["a"], r["b"], r["c"]) for r in got) and len(got) == len(data)
    held = Counter()
    for r in got:
        held[r["part"]] += r["n"]
    assert all(n - max(r["n"] for r in got if r["part"] == p) < part_bytes for p, n in held.items())
    assert set(held) == set(range(len(held))) and len(held) <= sum(n for *_, n in data) // part_bytes + 1 + spark.sparkContext.defaultParallelism
    assert in_byte_order(df.limit(0), 0, hs.F.col("n"), "a", "b", "c").count() == 0


def test_files_are_pruned(spark):
    """A file's bounds are narrow in each dimension: readers that filter on one skip most files."""
    rng = random.Random(4)
    data = [(k, "w" * rng.randrange(1, 2000), rng.choice("abcdefgh"), rng.choice("pqrstuvw"), None) for k in range(3000)]
    df = spark.createDataFrame([(d, t, x, s, len(t)) for d, t, x, s, _ in data], SCHEMA)
    got = hs.write_shards(df, scratch(spark, "test-prune"), shards=64, part_bytes=100_000).collect()
    for column in ("source", "lang", "n_chars"):
        bounds = [(min(v), max(v)) for v in ([r[column] for r in got if r["shard"] == s] for s in range(64))]
        asked = rng.sample(sorted(r[column] for r in got), 40)
        read = [sum(lo <= x <= hi for lo, hi in bounds) for x in asked]
        assert sum(read) / len(read) < 64 / 2, column
        assert all(read)


def test_shard_query(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = hs.query(spark, str(tmp_path)).collect()
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows()), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    assert hs.write_shards(spark.createDataFrame([], SCHEMA), scratch(spark, "none")).count() == 0


# Pfair mixing


def fluid(weights, blocks):
    """What each source has had at every slot if all flow side by side, by plain fractions."""
    left, had, out = [Fraction(b) for b in blocks], [Fraction(0)] * len(blocks), []
    at, slot = Fraction(0), 0
    while slot <= sum(blocks):
        flows = [s for s in range(len(blocks)) if left[s]]
        if at == slot:
            out.append(list(had))
            slot += 1
            continue
        total = sum(weights[s] for s in flows)
        step = min([left[s] * total / weights[s] for s in flows] + [slot - at])
        for s in flows:
            left[s] -= step * weights[s] / total
            had[s] += step * weights[s] / total
        at += step
    return out


@pytest.mark.parametrize("seed", range(20))
def test_schedule_keeps_every_share_while_sources_end(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 4, 60])
    weights = [rng.choice([1, 3, 1000, rng.randrange(1, pfair_mix.PARTS)]) for _ in range(n)]
    blocks = [rng.choice([0, 1, rng.randrange(40), rng.randrange(12)]) for _ in range(n)]
    out = list(pfair_mix.schedule(weights, blocks))
    assert [r[4] for r in out] == list(range(sum(blocks)))
    assert sorted((r[0], r[1]) for r in out) == [(s, k) for s in range(n) for k in range(blocks[s])]
    want, done = fluid(weights, blocks), [0] * n
    for t, r in enumerate(out, 1):
        done[r[0]] += 1
        assert r[2] <= r[4] < r[3]
        assert all(abs(done[s] - want[t][s]) < 1 for s in range(n))
    # releases and deadlines are where the fluid schedule passes a block's ends
    for s, k, release, deadline, _ in out:
        assert want[release][s] <= k < want[release + 1][s] and want[deadline - 1][s] < k + 1 <= want[deadline][s]
    # stretches that are found side by side make the same schedule
    for stretch in (1, 7, 50):
        assert [r for k in range(0, sum(blocks), stretch) for r in pfair_mix.schedule(weights, blocks, k, k + stretch)] == out


def test_schedule_of_large_numbers():
    weights, blocks = [10**6] * 40 + [1] * 3, [10**15] * 40 + [3] * 3
    out = list(pfair_mix.schedule(weights, blocks, 10**12, 10**12 + 100))
    assert [r[4] for r in out] == list(range(10**12, 10**12 + 100)) and all(r[2] <= r[4] < r[3] for r in out)


@pytest.mark.parametrize("weights,stretch", [(None, 10**5), (None, 5), ({"a": 5.0, "b": 1.0}, 3)])
def test_mix(spark, weights, stretch):
    data = rows(n=80)
    unit = 1500
    got = pfair_mix.mix(with_clashes(frame(spark, data), "slot", "bucket"), weights, unit, stretch=stretch).collect()
    assert sorted(str((r["doc_id"], r["source"])) for r in got) == sorted(str((d, s)) for d, _, _, s, _ in data)
    size = Counter()
    for _, t, _, s, _ in data:
        size[s] += len((t or "").encode()) + pfair_mix.ROW_BYTES
    names = sorted(size, key=lambda s: (s is not None, s or ""))
    share = [weights.get(s, 1.0) for s in names] if weights else [size[s] ** pfair_mix.TEMPERATURE for s in names]
    parts = [max(1, math.floor(pfair_mix.PARTS * x / max(share) + 0.5)) for x in share]
    blocks = [-(-size[s] // unit) for s in names]
    want = fluid(parts, blocks)
    # documents of a source come in one order, and lie in the block that their first byte lies in
    length = {(d, s, hash(t or "")): len((t or "").encode()) + pfair_mix.ROW_BYTES for d, t, _, s, _ in data}
    first = {}
    for r in got:
        k = names.index(r["source"])
        assert want[r["release"]][k] <= r["block"] < want[r["release"] + 1][k]
        assert want[r["deadline"] - 1][k] < r["block"] + 1 <= want[r["deadline"]][k]
        assert r["release"] <= r["slot"] < r["deadline"]
        assert first.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    for s in names:
        ordered = sorted((r for r in got if r["source"] == s), key=lambda r: (r["slot"], r["nth"]))
        assert [r["block"] for r in ordered] == sorted(r["block"] for r in ordered)
        sizes = Counter(d for d, t, _, x, _ in data if x == s)
        if max(sizes.values()) == 1:
            at = 0
            for r in ordered:
                assert r["block"] == at // unit
                at += next(v for (d, x, _), v in length.items() if d == r["doc_id"] and x == s)
    for slot in {r["slot"] for r in got}:
        assert sorted(r["nth"] for r in got if r["slot"] == slot) == list(range(1, 1 + sum(r["slot"] == slot for r in got)))
    assert len(first) == len(set(first.values()))


def test_light_sources_make_stretches_hold_no_more():
    """A block that is in flight for many stretches makes later ones begin early, but what is held stays that of a stretch."""
    for weights, blocks in (([1_000_000, 1], [60_000, 1]), ([1_000_000] * 10 + [1], [5_000] * 10 + [1]), ([7, 5, 1], [9_000, 9_000, 1])):
        total, stretch, whole = sum(blocks), 1000, list(pfair_mix.schedule(weights, blocks))
        assert [r[4] for r in whole] == list(range(total))
        for k in (0, 1, 7, total // stretch - 1):
            held = []
            assert list(pfair_mix.schedule(weights, blocks, k * stretch, (k + 1) * stretch, 0, stretch, held)) == whole[k * stretch : (k + 1) * stretch]
            assert max(held) <= 2 * stretch + len(weights)


def test_stretches_change_nothing_and_hold_little(spark):
    """The schedule of many sources that end is one, whatever the stretch; no group holds all blocks."""
    rng = random.Random(8)
    sources = [(f"s{k}" if k else None, rng.choice([1, 50, 1000]), rng.choice([1, 4, 30])) for k in range(60)]
    df = spark.createDataFrame(sources, "source string, w long, n long")
    whole, cut = (sorted(map(tuple, pfair_mix.plan_slots(df, x).collect()), key=str) for x in (10**6, 40))
    assert whole == cut and len(whole) == sum(n for *_, n in sources)


def test_mixed_rows_stand_in_order(spark):
    data = [r for r in rows(n=80) if r[0] is not None]
    df = frame(spark, data)
    out = pfair_mix.mixed(df, block_bytes=1500)
    at = {(r["doc_id"], r["source"]): (r["slot"], r["nth"]) for r in pfair_mix.mix(df, block_bytes=1500).collect()}
    got = out.collect()
    assert out.columns == df.columns and len(got) == len(data)
    places = [at[r["doc_id"], r["source"]][0] for r in got]
    assert places == sorted(places)
    assert pfair_mix.mixed(spark.createDataFrame([], SCHEMA)).count() == 0


# I-Match


def _brute_prints(data, least, most):
    """Fingerprints by plain sets of terms."""
    import re

    term = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    sets = [{x.lower() for x in term.findall((t or "").encode())} for _, t, *_ in data]
    df = Counter(x for s in sets for x in s)
    return {x for x, n in df.items() if least <= math.log2(len(data) / n) <= most}, sets


@pytest.mark.parametrize("range_bytes", [64 << 20, 2000])
def test_fingerprints(spark, range_bytes):
    data = sorted((r for r in rows(n=60)[:-3]), key=lambda r: r[0])
    got = {r["doc_id"]: r for r in imatch.fingerprints(with_clashes(frame(spark, data), "Fingerprint", "r", "key", "__id"), least=1.0, most=5.0, range_bytes=range_bytes).collect()}
    assert sorted(got) == [r[0] for r in data]
    band, sets = _brute_prints(data, 1.0, 5.0)
    of_text = {}
    for k, (d, t, *_) in enumerate(data):
        t, after = t or "", data[(k + 1) % len(data)][1] or ""
        n = len(t) // 4
        r = got[d]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
        assert of_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["fingerprint"].startswith("text-") == (not sets[k] & band)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == after:
            assert r["near_next"] == 1
    # all terms of the band count: the dense subset's hash is equal just where the sets of terms are
    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i] & band, sets[j] & band
            if a and b:
                x, y = got[data[i][0]]["fingerprint"], got[data[j][0]]["fingerprint"]
                assert (x[: imatch.DIGITS] == y[: imatch.DIGITS]) == (a == b)
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()])


def test_likeness_by_plain_sets(spark):
    """All 47 subsets, by sets of terms: which hashes are filled, which are equal, and both likenesses."""
    import re

    rng = random.Random(3)
    words = [f"{rng.choice(['w', 'Ö', 'k9'])}{k:x}" for k in range(600)]
    bodies = [" ".join(words[int(600 * rng.random() ** 2)] for _ in range(rng.randrange(3, 150))) for _ in range(70)]
    bodies += [bodies[3], bodies[4] + " and so on", bodies[5].upper(), *[t for _, t, *_ in rows(seed=3, n=8)[8:-3]]]
    data = [(5 * k, t, None, None, None) for k, t in enumerate(bodies)]
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, data), least=1.0, most=5.0, range_bytes=3000).collect()}
    band, _ = _brute_prints(data, 1.0, 5.0)
    seats = {x: int(imatch.term_hashes(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]))[1][0]) for x in band}
    draw = lambda k, h: int(imatch.tb.mix(np.array([h], dtype=np.uint64) ^ imatch.tb.mix(np.array([k + 1], dtype=np.uint64)))[0])
    subsets = [{x for x, h in seats.items() if draw(k, h) % d == 0} for k, d in enumerate(imatch.DENSITIES)]
    assert subsets[0] == band and len(band) > 200 and any(subsets[-16:])

    def row(t):
        terms = {x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode())}
        return [frozenset(terms & s) for s in subsets]

    def like(a, b):
        x, y = row(a), row(b)
        either = sum(bool(p or q) for p, q in zip(x, y))
        return sum(p == q and bool(p) for p, q in zip(x, y)) / either if either else float(a == b)

    texts = [t or "" for _, t, *_ in data]
    seen = {}
    for k, (d, *_) in enumerate(data):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        assert got[d]["near_edited"] == pytest.approx(like(t, changed))
        assert got[d]["near_next"] == pytest.approx(like(t, after))
        for body, print_ in ((t, got[d]["fingerprint"]), (changed, got[d]["edited_fingerprint"])):
            if print_.startswith("text-"):
                assert not any(row(body))
                continue
            parts = [print_[i : i + imatch.DIGITS] for i in range(0, len(print_), imatch.DIGITS)]
            for i, (part, terms) in enumerate(zip(parts, row(body), strict=True)):
                assert (part == "-" * imatch.DIGITS) == (not terms)
                if terms:
                    assert seen.setdefault((i, terms), part) == part
    values = Counter((i, part) for (i, _), part in seen.items())
    assert max(values.values()) == 1


def test_fingerprints_of_odd_tables(spark):
    assert imatch.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(5, "abcdefgh", None, None, None)], SCHEMA)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert imatch.fingerprints(frame(spark)).count() == len(rows())
