import re

import pytest

from rollcall.llm import jaccard_join as jj

from .data import SCHEMA, frame, rows, with_clashes

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(data, size, num, den):
    sets = [shingles(r[1], size) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(data)
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(data)):
        if data[i][0] is not None:
            least[find(i)] = min(least.get(find(i), data[i][0]), data[i][0])
    return sorted(((data[i][0], len(sets[i]), least.get(find(i)), links[i]) for i in range(len(data))), key=str)


def near_copies(seed=5):
    """A large group of near copies, chained, and documents that share a passage."""
    import random

    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(90)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append((1000 + k, " ".join(copy), "en", "a", 1))
        out.append((2000 + k, " ".join(passage + [rng.choice(words) for _ in range(rng.randrange(5, 60))]), "en", "a", 1))
    return out


@pytest.mark.parametrize("size,num,den,chunk", [(3, 90, 100, 10**6), (5, 80, 100, 10**6), (3, 90, 100, 1500)])
def test_components(spark, monkeypatch, size, num, den, chunk):
    monkeypatch.setattr(jj, "CHUNK_ELEMENTS", chunk)
    data = rows() + near_copies()
    got = jj.jaccard_components(with_clashes(frame(spark, data), "node", "links"), size, num, den, count_links=True).collect()
    want = brute(data, size, num, den)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == want
    monkeypatch.setattr(jj, "STAR_ELEMENTS", chunk)
    got = jj.jaccard_components(with_clashes(frame(spark, data), "Node", "hub", "__row"), size, num, den, thin=size == 5).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(((d, n, c) for d, n, c, _ in want), key=str)


def test_one_of_each_group_stays(spark):
    data = [r for r in rows() if r[0] is not None] + near_copies()
    want = brute(data, 5, 80, 100)
    empty = sum(n == 0 for _, n, _, _ in want)
    kept = jj.deduplicate(with_clashes(frame(spark, data), "__id", "__ROW", "chosen", "a.b"))
    assert kept.columns == frame(spark, data).columns + ["__id", "__ROW", "chosen", "a.b"]
    got = kept.collect()
    assert len(got) == empty + len({c for _, n, c, _ in want if n})
    assert {r["doc_id"] for r in got} == {d for d, n, c, _ in want if not n or d == c}


def test_work_on_near_copies_is_linear(spark, monkeypatch):
    """A group of near copies is sent to the trie join with at most its few outsiders, each text a fixed number of times."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    data = []
    for k in range(300):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"x{k}"
        data.append((k, " ".join(copy), "en", "a", 1))
    # shares most keys with the group and doesn't link with it
    data.append((5000, " ".join(base[:75] + [f"y{k}" for k in range(75)]), "en", "a", 1))
    monkeypatch.setattr(jj, "CHUNK_ELEMENTS", 2000)
    seen = []
    joined = jj.linked_nodes
    monkeypatch.setattr(jj, "linked_nodes", lambda blocks, *more: seen.extend(blocks.select("node").collect()) or joined(blocks, *more))
    got = jj.jaccard_components(frame(spark, data)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, c) for d, _, c, _ in brute(data, 3, 90, 100)}
    # an outsider may meet all chunks of the group, its members at most the outsiders
    assert len(seen) <= 2 * len(data) + 50


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jj.jaccard_components(empty).count() == 0 and jj.deduplicate(empty).count() == 0
