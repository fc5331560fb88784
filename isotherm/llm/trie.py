"""A prefix tree of globally ordered sets, and the join that runs down it."""

from __future__ import annotations

import numpy as np


def linked(inter, a, b):
    """Whether sets of sizes a and b with that many common members have a Jaccard similarity of 0.75 or more."""
    return 100 * inter >= 75 * (a + b - inter)


class Groups:
    """Union-find."""

    def __init__(self, labels):
        first: dict = {}
        self.parent = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def trie_join(sets: list[np.ndarray], labels=None, minor: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs among the sets connect (a forest, not all pairs).

    sets: members as numbers in one global order, ascending. labels: sets with one label count as connected.
    minor: only pairs with at least one set so marked are looked at.

    The sets, sorted as sequences, are the leaves of a trie whose nodes are runs of sets with a common beginning.
    Going down, a node's own members are looked up once for all sets below it, adding to the overlaps with every
    other set; those whose overlap cannot reach the bound any more, by what is left below, are dropped there.
    """
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    posting, count = owner[order], np.bincount(flat, minlength=len(names))
    start = np.cumsum(count) - count
    ends = np.cumsum(size)
    rows = [flat[e - k : e] for e, k in zip(ends, size, strict=True)]
    # equal members at the beginning: sort the sets as big-endian strings
    place = sorted(range(n), key=lambda k: rows[k].astype(">u4").tobytes())
    groups, out = Groups(labels if labels is not None else range(n)), []
    rank = np.empty(n, np.int64)
    rank[place] = np.arange(n)

    def overlaps(members: np.ndarray) -> np.ndarray:
        many = count[members]
        at = np.repeat(start[members] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return np.bincount(posting[at], minlength=n)

    stack = [(0, n, 0, np.arange(n), np.zeros(n, np.int64))]
    while stack:
        low, high, depth, active, inter = stack.pop()
        here = place[low:high]
        least, most = int(size[here].min()), int(size[here].max())
        a, b = rows[here[0]], rows[here[-1]]
        if high - low == 1:
            end = len(a)
        else:
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:k] != b[depth:k])
            end = depth + int(differ[0]) if len(differ) else k
        step = 32
        while depth < end and len(active):
            to = min(end, depth + step)
            inter = inter + overlaps(a[depth:to])
            depth, step = to, 2 * step
            best = np.minimum(inter[active] + most - depth, size[active])
            active = active[linked(best, least, size[active])]
        if not len(active):
            continue
        if high - low == 1:
            k = here[0]
            other = active[rank[active] < low]
            if minor is not None and not minor[k]:
                other = other[minor[other]]
            for j in other[linked(inter[other], size[k], size[other])].tolist():
                if groups.join(k, j):
                    out.append((k, j))
            continue
        begin = low
        while begin < high:
            row = rows[place[begin]]
            stop = begin + 1
            if len(row) > end:
                while stop < high and rows[place[stop]][end] == row[end]:
                    stop += 1
            stack.append((begin, stop, end, active, inter))
            begin = stop
    return out
