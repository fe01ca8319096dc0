import numpy as np
import pytest

from rollcall.llm.jaccard_join import Levels, merged_keys, path_keys
from rollcall.llm.prefix_tree import Trie, least_labels


def _sets(seed, n=150):
    """Sets of all lengths, with near copies of one another, in three blocks."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            base = list(out[rng.integers(len(out))])
            for _ in range(rng.integers(0, 1 + max(1, len(base) // 8))):
                if rng.random() < 0.5 and len(base) > 1:
                    base.pop(rng.integers(len(base)))
                else:
                    base.append(int(rng.integers(1 << 62)))
            out.append(frozenset(base))
        else:
            out.append(frozenset(rng.integers(1 << 62, size=rng.integers(1, 300)).tolist()))
    return sorted(set(out), key=sorted)


def _arrays(sets):
    lens = np.array([len(x) for x in sets], dtype=np.int64)
    return lens, np.concatenate([np.sort(np.array(sorted(x), dtype=np.uint64)) for x in sets])


def _linked(a, b, num, den):
    both = len(a & b)
    return den * both >= num * (len(a) + len(b) - both)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (1, 2)])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_finds_every_link(seed, num, den):
    sets = _sets(seed)
    lens, elements = _arrays(sets)
    group = np.arange(len(sets)) % 3
    want = {(i, j) for i in range(len(sets)) for j in range(i) if group[i] == group[j] and _linked(sets[i], sets[j], num, den)}
    got = [(int(x), int(y)) for a, b in Trie(group, lens, elements).links(num, den) for x, y in zip(a, b)]
    assert len(got) == len(set(got))
    assert {(max(p), min(p)) for p in got} == want
    assert want


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_leaves_out_what_is_settled(seed):
    sets = _sets(seed)
    lens, elements = _arrays(sets)
    group = np.arange(len(sets)) % 3
    trie = Trie(group, lens, elements)
    every = {(max(p), min(p)) for a, b in trie.links(4, 5) for p in zip(a.tolist(), b.tolist())}
    near = {(max(p), min(p)) for p in zip(*(x.tolist() for x in trie.neighbours(4, 5)))}
    assert near and near <= every
    one, two = np.arange(len(sets)) % 7, np.arange(len(sets)) // 40
    got = {(max(p), min(p)) for a, b in trie.links(4, 5, (one, two)) for p in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i, j in every if one[i] != one[j] and two[i] != two[j]}
    # what the neighbours connect needs no further look
    labels = least_labels(np.arange(len(sets)), *trie.neighbours(4, 5))
    full = least_labels(np.arange(len(sets)), *(np.array(x) for x in zip(*every)))
    for a, b in trie.links(4, 5, (labels,)):
        labels = least_labels(labels, a, b)
    assert (labels == full).all()


@pytest.mark.parametrize("popular", [None, 1, 2, 40])
@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
@pytest.mark.parametrize("seed", [3, 4])
def test_linked_sets_share_a_key(seed, num, den, popular):
    sets = _sets(seed)
    lens, elements = _arrays(sets)
    if popular is not None:
        values, count = np.unique(elements, return_counts=True)
        popular = values[count >= popular]
    keys, owner = path_keys(lens, elements, Levels(num, den), popular)
    of = [set(keys[owner == i].tolist()) for i in range(len(sets))]
    for i in range(len(sets)):
        for j in range(i):
            if _linked(sets[i], sets[j], num, den):
                assert of[i] & of[j], (lens[i], lens[j])


def test_merged_keys_keep_what_is_connected():
    keys = np.array([5, 5, 5, 7, 7, 9], dtype=np.uint64)
    nodes = np.array([3, 1, 2, 2, 8, 4], dtype=np.uint64)
    k, v = merged_keys(keys, nodes)
    groups = {}
    for a, b in zip(k.tolist(), v.tolist()):
        groups.setdefault(a, set()).add(b)
    assert sorted(map(sorted, groups.values())) == [[1], [1, 2], [1, 3], [2], [2, 8], [4]]


def test_labels_are_the_least_row():
    labels = least_labels(np.arange(7), np.array([5, 3, 6]), np.array([3, 1, 4]))
    assert labels.tolist() == [0, 1, 2, 1, 4, 1, 4]
    assert least_labels(np.arange(3), np.array([], dtype=int), np.array([], dtype=int)).tolist() == [0, 1, 2]
