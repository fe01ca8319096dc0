from collections import defaultdict

import numpy as np
import pytest

from rollcall.llm import line_dedup as ld

from .data import SCHEMA, frame, rows, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = ["A line that many documents share, in full length.", "ünïcödé " * 5 + "end", "x" * 40, "y" * 39, "é" * 40, "a line of fewer documents, which is long as well"]


def shared(seed=4):
    import random

    rng = random.Random(seed)
    out = []
    for k in range(60):
        lines = [f"a line of its own, number {k}, long enough to be a key"]
        for s in SHARED[:5]:
            if rng.random() < 0.4:
                lines.append(rng.choice(["", "\t", " \r", "\x0b"]) + (s.upper() if rng.random() < 0.3 and s.isascii() else s) + rng.choice(["", " ", "\r", "\x0c "]))
        if k < 4:
            lines.append(SHARED[5])
        lines += rng.choice([[], [""], ["", ""]]) + rng.choice([[], [lines[-1]]])
        rng.shuffle(lines)
        out.append((300 + k, "\n".join(lines), "en", "a", 1))
    out += [(400, SHARED[0], "en", "a", 1), (401, "\n".join([SHARED[0]] * 3), "en", "a", 1), (401, SHARED[0], "en", "a", 1), (None, SHARED[0] + "\n" + SHARED[2], "en", "a", 1)]
    return out


def brute(data, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    holders = defaultdict(set)
    for n, r in enumerate(data):
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(n)
    low = lambda x: ld.NO_ID if x is None else x
    keeper = {k: max(low(data[n][0]) for n in v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for r in data:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if key(x) not in keeper or keeper[key(x)] == low(r[0])]
        out.append((r[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("index_bytes,shard_keys", [(ld.INDEX_BYTES, ld.SHARD_KEYS), (ld.INDEX_BYTES, 2), (0, 2), (0, ld.SHARD_KEYS)])
def test_lines(spark, index_bytes, shard_keys):
    data = rows() + shared()
    out = ld.drop_lines(with_clashes(frame(spark, data), "N_Lines", "kept_text", "__row", "h1", "a.b"), index_bytes=index_bytes, shard_keys=shard_keys)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"__row", "h1", "a.b", "text"} <= set(out.columns)
    want = brute(data)
    assert sum(n for _, _, n, _ in want) > 50
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()), key=str) == want


def test_other_bounds(spark):
    data = rows() + shared()
    out = ld.drop_lines(frame(spark, data), min_chars=1, min_docs=2)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()), key=str) == brute(data, 1, 2)


def test_the_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 100_000):
        h1, h2 = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 64, n, dtype=np.uint64)
        h1[: n // 4] = h1[0] if n else 0  # pairs differ, their first halves needn't
        shard = ld.Shard(ld.Shard.built(0, h1, h2, np.arange(n) + (1 << 31), np.arange(n)))
        assert sorted(shard.hash.slots(h1, h2)) == list(range(n))
        known, counts, keepers = shard.probe(h1, h2)
        assert known.all() and (counts == np.arange(n) + (1 << 31)).all() and (keepers == np.arange(n)).all()
        assert not shard.probe(h2, h1 ^ np.uint64(1))[0].any()
        assert n < 1000 or len(shard.hash.words) * 8 < 0.6 * n


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ld.drop_lines(empty).count() == 0 and ld.drop_lines(empty, index_bytes=0).count() == 0


def test_the_sql_agrees():
    import hashlib

    import duckdb
    import pandas as pd

    data = [r for r in rows() + shared() if r[0] is not None]
    documents = pd.DataFrame({"doc_id": [r[0] for r in data], "text": [r[1] for r in data]})  # noqa: F841
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute(data)]
    assert sorted(duckdb.sql(ld.ORACLE_SQL).fetchall(), key=str) == sorted(want, key=str)
