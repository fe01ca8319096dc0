import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rollcall.llm import turn_trie as tt

from .data import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed=6):
    rng = random.Random(seed)
    out = []
    ids = [*range(0, 30), *range(95, 130), 250, 251, 299, 300, 100_007, -1, -150, -100, -199, 2**40 + 5, 2**40 + 6]
    for c in ids:
        first = rng.choice([[], ["hello"], ["hello", "hi"], ["hello", "hi", "so"]])
        said = first + [rng.choice(["yes", "no", "naïve 😀", "", None]) for _ in range(rng.randrange(1 if first else 3, 9))]
        for k, text in enumerate(said):
            out.append((c, k if rng.random() < 0.95 else None, rng.choice(["user", "user", "assistant", None]) if k % 3 == 2 else "user", text))
        if rng.random() < 0.2:
            out.append(out[-1])
    for c in range(500, 520):  # copies
        out += [(c, k, "user", "copy" * (k + 1)) for k in range(3)]
    out += [(700, k, "user", f"long {k % 7}") for k in range(150)] + [(701, k, "user", f"long {k % 7}") for k in range(140)]
    out += [(None, 0, "user", "no conversation"), (None, None, None, None), (800, None, None, None)]
    return out


def brute(rows):
    own = defaultdict(list)
    low = lambda t: (0, 0) if t is None else (1, t)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((low(turn), (role or "").encode(), (text or "").encode()))
    own = {c: [(r.decode(), t.decode()) for _, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        full[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            nodes[tuple(full[c][:d])].append(c)
    own_saved = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in nodes.items()}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own_saved[p]
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in m if len(full[c]) == len(p))
        out.append((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("stretch", [1 << 10, 4])
def test_nodes(spark, monkeypatch, stretch):
    monkeypatch.setattr(tt, "STRETCH", stretch)
    rows = conversations()
    frame = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3), "name", "Depth", "pos", "len", "a.b")
    got = tt.rebuilt_nodes(frame)
    assert got.columns == NAMES
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    # 1 has h = 1 and one turn, and there is no conversation 0
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1)
    got = tt.rebuilt_nodes(spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_digests_pass_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        ends = spark.createDataFrame([(1, n % 2, n) for n in range(20, -20, -1)], "depth long, conv_id long, member long")
        got = {r["conv_id"]: r["ends_sha256"] for r in tt.digests(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: hashlib.sha256(",".join(str(n) for n in range(-19, 21) if n % 2 == k).encode()).hexdigest() for k in (0, 1)}


def test_empty(spark):
    assert tt.rebuilt_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tt.rebuilt_nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_the_sql_agrees():
    import duckdb
    import pandas as pd

    rows = conversations()
    conversations_ = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    duckdb.register("conversations", conversations_)
    assert sorted(duckdb.sql(tt.ORACLE_SQL).fetchall(), key=str) == brute(rows)
