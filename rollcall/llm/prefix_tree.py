"""A prefix tree (trie) over ordered sets, joined with itself by Jaccard similarity.

The sets of a block are put in one order of their elements (those in most sets
first, so that similar sets share long paths) and stored as the paths of a trie
whose unbranched stretches are single segments. All sets then walk down the
trie together. A walk carries the overlap of its set with the path so far, which
all sets below the path share, and ends where the lengths of the sets below, or
what is left of its own set and of the longest path below, can't reach the
overlap that the threshold asks for.

Who asks for components and not for links may say which pairs need not be looked at
(sets that are known to be connected): subtrees of nothing else end a walk, too. Near copies
lie side by side in the order of paths, so linking neighbours first joins most of
a group at a cost that grows with the sets' sizes, not with their pairs.
"""

from __future__ import annotations

import numpy as np

from .textbytes import mix

#: A segment has at most so many elements, so that a walk can end inside a long stretch.
SEGMENT = 96
#: Walks are taken so many at a time that their tables stay within this many bytes or entries.
TABLE_BYTES, FRONTIER = 24 << 20, 1 << 20


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lens[i] - 1, for one i after the other."""
    at = np.cumsum(lens) - lens
    return np.arange(int(lens.sum())) + np.repeat(starts - at, lens)


class Trie:
    """group: the block of each set; rows of other blocks are never met. sets: element hashes, distinct in a set."""

    def __init__(self, group: np.ndarray, lens: np.ndarray, elements: np.ndarray):
        row = np.repeat(np.arange(len(lens)), lens)
        of = group[row]
        key = mix(elements ^ mix(of.astype(np.uint64)))
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        order = np.lexsort((first, -count, of[first]))
        token = np.empty(len(order), dtype=np.int64)
        begin = np.searchsorted(of[first][order], of[first][order], side="left")
        token[order] = np.arange(len(order)) - begin
        keys = np.sort((row << 32) | token[inverse])
        tokens = (keys & 0xFFFFFFFF).astype(">u4")
        start = np.cumsum(lens) - lens
        paths = [(int(g), tokens[a : a + n].tobytes()) for g, a, n in zip(group, start, lens)]
        #: rows in the order of their paths
        self.rows = np.array(sorted(range(len(lens)), key=paths.__getitem__), dtype=np.int64)
        self.group, self.length = group[self.rows], lens[self.rows]
        self.start = np.cumsum(self.length) - self.length
        self.tokens = tokens[_spread(start[self.rows], self.length)].astype(np.int64)
        self.keys = (np.repeat(np.arange(len(lens)), self.length) << 32) | self.tokens
        vocabulary = np.bincount(of[first], minlength=int(group.max()) + 1 if len(group) else 1)
        self.width = vocabulary[self.group]
        self._segments()

    def _segments(self) -> None:
        n = len(self.rows)
        shared = [0] * n
        for r in range(1, n):
            if self.group[r] == self.group[r - 1]:
                m = int(min(self.length[r], self.length[r - 1]))
                a = self.tokens[self.start[r] : self.start[r] + m]
                b = self.tokens[self.start[r - 1] : self.start[r - 1] + m]
                differ = np.flatnonzero(a != b)
                shared[r] = int(differ[0]) if len(differ) else m
        owner, stack = [-1] * n, []
        cuts: list[list[int]] = [[] for _ in range(n)]
        for r in range(n):
            if r and self.group[r] != self.group[r - 1]:
                stack = []
            while stack and shared[stack[-1]] >= max(shared[r], 1):
                stack.pop()
            if shared[r]:
                owner[r] = stack[-1]
                cuts[owner[r]].append(shared[r])
            stack.append(r)
        seg, at = [], {}
        for r in range(n):
            lo, hi = shared[r], int(self.length[r])
            ends = sorted({*cuts[r], hi, *range(lo + SEGMENT, hi, SEGMENT)} - {lo}) if hi > lo else []
            parent = at[owner[r], lo] if lo else -1
            for e in ends:
                seg.append((r, lo, e, parent))
                parent, lo = len(seg) - 1, e
                at[r, e] = parent
        row, lo, hi, parent = (np.array(x, dtype=np.int64) for x in zip(*seg)) if seg else (np.zeros(0, dtype=np.int64),) * 4
        self.s_row, self.s_lo, self.s_hi, self.s_parent = row, lo, hi, parent
        self.s_start = self.start[row] + lo
        #: the set that ends where the segment ends, or -1
        self.s_set = np.where(hi == self.length[row], row, -1) if len(seg) else row
        self.s_min = np.where(self.s_set >= 0, hi, np.iinfo(np.int64).max)
        self.s_max = np.where(self.s_set >= 0, hi, 0)
        #: the sets below a segment are rows s_row .. s_end - 1
        self.s_end = row + 1
        for s in range(len(seg) - 1, -1, -1):
            if (p := parent[s]) >= 0:
                self.s_min[p] = min(self.s_min[p], self.s_min[s])
                self.s_max[p] = max(self.s_max[p], self.s_max[s])
                self.s_end[p] = max(self.s_end[p], self.s_end[s])
        order = np.argsort(parent, kind="stable")
        self.children = order
        bounds = np.searchsorted(parent[order], np.arange(-1, len(seg) + 1))
        self.c_lo, self.c_hi = bounds[1:-1], bounds[2:]
        roots = order[: bounds[1]]
        self.roots = roots[np.argsort(self.group[row[roots]], kind="stable")] if len(seg) else roots

    def neighbours(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """The links among pairs of rows (as given) that are next to one another in the order of paths."""
        n = len(self.rows)
        if n < 2:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(n), self.length)
        later = row > 0
        key = ((row[later] - 1) << 32) | self.tokens[later]
        hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        overlap = np.bincount(row[later], weights=hit, minlength=n).astype(np.int64)[1:]
        linked = (self.group[1:] == self.group[:-1]) & (den * overlap >= num * (self.length[1:] + self.length[:-1] - overlap))
        return self.rows[1:][linked], self.rows[:-1][linked]

    def links(self, num: int, den: int, settled: tuple[np.ndarray, ...] = ()):
        """Pairs of rows (as given) whose overlap is at least num / den of their union, in arrays of some of them; each pair once.

        settled: arrays of a number for each row; pairs that agree in one of them are left out.
        """
        n = len(self.rows)
        if not len(self.s_row):
            return
        self._settled = []
        for numbers in settled:
            own = numbers[self.rows]
            change = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, n)
            # whether all sets below a segment agree
            one = change[np.searchsorted(change, self.s_row, side="right")] >= self.s_end
            self._settled.append((own, one))
        root_group = self.group[self.s_row[self.roots]]
        r_lo = np.searchsorted(root_group, self.group, side="left")
        r_hi = np.searchsorted(root_group, self.group, side="right")
        cost = np.cumsum(np.maximum(self.width, 1))
        reach = np.cumsum(np.maximum(r_hi - r_lo, 1))
        lo = 0
        while lo < n:
            base_cost, base_reach = (cost[lo - 1], reach[lo - 1]) if lo else (0, 0)
            hi = max(lo + 1, int(min(np.searchsorted(cost, base_cost + TABLE_BYTES, side="right"), np.searchsorted(reach, base_reach + FRONTIER, side="right"))))
            yield from self._walk(lo, hi, r_lo, r_hi, num, den)
            lo = hi

    def _walk(self, lo: int, hi: int, r_lo: np.ndarray, r_hi: np.ndarray, num: int, den: int):
        width = self.width[lo:hi]
        base = np.cumsum(width) - width
        table = np.zeros(int(width.sum()), dtype=np.uint8)
        a, b = self.start[lo], self.start[hi - 1] + self.length[hi - 1]
        table[np.repeat(base, self.length[lo:hi]) + self.tokens[a:b]] = 1
        count = (r_hi - r_lo)[lo:hi]
        probe = np.repeat(np.arange(lo, hi), count)
        seg = self.roots[_spread(r_lo[lo:hi], count)]
        overlap = np.zeros(len(probe), dtype=np.int64)
        todo = [(probe, seg, overlap)]
        while todo:
            probe, seg, overlap = todo.pop()
            size = self.length[probe]
            # only sets before the probe's own (each pair once), and of a length that can be similar
            fit = (self.s_row[seg] < probe) & (den * self.s_max[seg] >= num * size) & (num * self.s_min[seg] <= den * size)
            for own, one in self._settled:
                fit &= ~(one[seg] & (own[self.s_row[seg]] == own[probe]))
            probe, seg, overlap, size = probe[fit], seg[fit], overlap[fit], size[fit]
            if not len(probe):
                continue
            lens = self.s_hi[seg] - self.s_lo[seg]
            hits = table[np.repeat(base[probe - lo], lens) + self.tokens[_spread(self.s_start[seg], lens)]]
            overlap = overlap + np.add.reduceat(hits, np.cumsum(lens) - lens, dtype=np.int64)
            end = self.s_set[seg]
            ends = end >= 0
            p, q, o = probe[ends], end[ends], overlap[ends]
            linked = (q < p) & (den * o >= num * (self.length[p] + self.length[q] - o))
            for own, _ in self._settled:
                linked &= own[p] != own[q]
            if linked.any():
                yield self.rows[p[linked]], self.rows[q[linked]]
            last = self.tokens[self.s_start[seg] + lens - 1]
            left = size - (np.searchsorted(self.keys, (probe << 32) | last, side="right") - self.start[probe])
            least = np.maximum(self.s_min[seg], -(-num * size // den))
            need = -(-num * (size + least) // (num + den))
            more = (overlap + np.minimum(left, self.s_max[seg] - self.s_hi[seg]) >= need) & (self.c_hi[seg] > self.c_lo[seg])
            probe, seg, overlap = probe[more], seg[more], overlap[more]
            count = self.c_hi[seg] - self.c_lo[seg]
            total = np.cumsum(count)
            begin = 0
            while begin < len(probe):
                done = total[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(total, done + FRONTIER, side="right")))
                c = count[begin:stop]
                todo.append((np.repeat(probe[begin:stop], c), self.children[_spread(self.c_lo[seg[begin:stop]], c)], np.repeat(overlap[begin:stop], c)))
                begin = stop


def least_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the number of a row of the same component) after the links a - b."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return labels
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
