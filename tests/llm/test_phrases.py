import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollcall.llm import phrases as ph

from .data import SCHEMA, frame, rows, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(data):
    for r in data:
        for piece in re.split("[.,;:!?\n\v\f\r]", (r[1] or "").translate(LOWER)):
            yield "und" if r[2] is None else r[2], re.findall("[^ \t]+", piece)


def brute(data, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for lang, w in pieces(data):
        n[lang] += len(w)
        for m in range(1, 6):
            for i in range(len(w) - m + 1):
                f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= min_count}
        inside = {}
        for g, a in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside.get(g[i : i + k], 0), a)
        ranked = []
        for g, a in often.items():
            if inside.get(g, 0) < a:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                ranked.append((-score, -a, " ".join(g).encode(), a, counts[g[:k]], counts[g[k:]]))
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(ranked)[:top]):
            out.append((lang, rank + 1, phrase.decode(), a, l, r, n[lang], -score))
    return sorted(out)


def chatter(seed=2):
    """Few words, so that phrases repeat words and each other; a hot phrase; piece ends of all kinds."""
    rng = random.Random(seed)
    out = []
    for k in range(60):
        words = [rng.choice("the the the a of of cat Dog naïve ÉTÉ été x y z".split()) + rng.choice(["", "", "", "", ".", "\n", ";", "\x0b"]) for _ in range(rng.randrange(80))]
        text = rng.choice(["  ", "\t", ""]) + " ".join(words) + rng.choice(["", " over and over again", "!over and over again"] * 3)
        out.append((500 + k, text, rng.choice(["en", "fr", None, ""]), "a", 1))
    return out + [(700, "same same same same same same " * 40, "en", "a", 1), (701, "?.! ,;", "de", "a", 1)]


def found(out):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("min_count,top,block,split", [(3, 2000, 1 << 20, 1 << 18), (2, 25, 2000, 7), (8, 5, 1, 1)])
def test_phrases(spark, monkeypatch, min_count, top, block, split):
    monkeypatch.setattr(ph, "FRAGMENTS", 500)
    data = rows() + chatter()
    docs = with_clashes(frame(spark, data), "word", "Rank", "key", "__row", "a.b")
    want = brute(data, min_count, top)
    assert len(want) > 15
    assert found(ph.collocations(docs, min_count=min_count, top=top, block_bytes=block, split=split)) == want


def test_a_large_word_has_several_partitions(spark):
    rows = spark.createDataFrame([("same other " * 50 + f"same other w{k}", "en") for k in range(20)] * 3, "text string, lang string")
    blocks = ph.word_blocks(rows.select("lang", "text"), 1)
    assert blocks.where("local = 0").count() == 60
    order = ph._short(np.array([0] + [1, 2] * 50 + [0, 1, 1, 2, 2, 1]))
    one = spark.createDataFrame([(order, [1, 2], [2, 1], [(2, 3000), (1, 3100)])], "order binary, local array<int>, ids array<long>, hot array<struct<id long, f long>>")
    pieces = ph.fragments(one, 40, 500)
    assert len({r["bucket"] for r in pieces.collect()}) > 2
    whole = Counter()
    for r in ph.mined(pieces, 40, 1000).collect():
        whole[bytes(r["key"])] += r["n"]
    plain = Counter()
    ids = [0] + [2, 1] * 50 + [0, 2, 2, 1, 1, 2]
    for i in range(len(ids)):
        for m in range(2, 6):
            g = ids[i : i + m]
            if len(g) == m and 0 not in g:
                plain[b"".join(x.to_bytes(5, "big") for x in g)] += 1
    assert whole == plain


def test_fragments_are_sent_and_received(monkeypatch):
    monkeypatch.setattr(ph, "TOGETHER", 3)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        pivot = int(rng.choice([1, 2, 255, 256, 65_535, 65_536, 2**24, 2**33, 2**39 + 5]))
        low = lambda n: [int(rng.integers(1, pivot + 1)) for _ in range(n)]
        a, b = int(rng.integers(0, 5)), int(rng.integers(0, 5))
        rows.append([0] * (4 - a) + low(a) + [pivot] + low(b) + [0] * (4 - b))
    rows, counts = np.array(rows, dtype=np.int64), rng.choice([1, 2, 255, 256, 2**31], 400)
    part = rng.integers(0, 2, 400).astype(np.int32)
    batch = ph._sent(rows, counts, part, np.where(rows[:, 4] > 300, 2, 1), 5)
    assert batch.column(0).to_pylist() == [0, 1, 2, 3, 4]
    got, times, many = ph._received(*batch.columns[1:])
    assert many.tolist() == sorted({p for p in rows[:, 4].tolist() if p > 300})
    key = lambda r, c: sorted((*x, n) for x, n in zip(r.tolist(), c.tolist()))
    assert key(got, times) == key(rows, counts)

def test_numbers_are_written_short():
    numbers = np.array([0, 1, 127, 128, 129, 16_383, 16_384, 2**21 - 1, 2**21, 2**28 - 1, 5, 2**28, 2**35 - 1])
    assert ph._long(ph._short(numbers)).tolist() == numbers.tolist() and len(ph._short(numbers)) == 4 + 3 * 2 + 2 * 3 + 2 * 4 + 2 * 5
    assert ph._long(ph._short(np.zeros(0, dtype=np.int64))).tolist() == []


def test_products_pass_64_bits(spark):
    a, n, l, r = 10**13 + 7, 3 * 10**14 + 1, 2 * 10**13 + 3, 5 * 10**13 + 9
    got = spark.range(1).selectExpr(f"CAST(1000 AS DECIMAL(38,0)) * CAST({a} AS DECIMAL(38,0)) * CAST({n} AS DECIMAL(38,0)) div (CAST({l} AS DECIMAL(38,0)) * CAST({r} AS DECIMAL(38,0))) AS x").first()["x"]
    assert got == 1000 * a * n // (l * r)


def test_rows_whose_keys_agree_stay_apart(monkeypatch):
    monkeypatch.setattr(ph.tb, "mix", lambda x: np.zeros(len(x), dtype=np.uint64))
    rows = np.array([[1, 2], [3, 4], [1, 2], [3, 5], [3, 4]], dtype=np.int64)
    got, n = ph._merged(rows, np.array([1, 10, 100, 1000, 10000]))
    assert {tuple(r): k for r, k in zip(got.tolist(), n.tolist())} == {(1, 2): 101, (3, 4): 10010, (3, 5): 1000}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ph.collocations(empty).count() == 0
    assert ph.collocations(spark.createDataFrame([(1, None, None, None, None), (2, " .", "en", "a", 1)], SCHEMA), min_count=1).count() == 0


def test_the_sql_agrees():
    import duckdb
    import pandas as pd

    data = rows() + chatter()
    documents = pd.DataFrame({"lang": [r[2] for r in data], "text": [r[1] for r in data]})  # noqa: F841
    assert sorted(duckdb.sql(ph.oracle_sql(3, 40)).fetchall()) == brute(data, 3, 40)


def test_the_join_of_numbers_has_a_row_for_each_word_of_a_block(spark, monkeypatch):
    """Its rows are in proportion to the blocks, however many words become frequent; blocks without such words go no further."""
    seen, fragments = [], ph.fragments
    monkeypatch.setattr(ph, "fragments", lambda blocks, *a: (seen.append(blocks), fragments(blocks, *a))[1])
    data = chatter() + [(5000, "nobody says this", "xx", "s", 1)]
    assert found(ph.collocations(frame(spark, data), min_count=4, top=50, block_bytes=300)) == brute(data, 4, 50)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "word#" in line and "Join" in line]
    assert joins and all("LeftOuter" in line for line in joins)
