"""Exact least costs from many origins at a time by nested dissection.

The nodes are divided by small separators, over and over. A front is a separator, or a part too small
to divide, with its boundary: the nodes of separators above that its part touches. Fronts are closed
from the smallest up (each holds the least costs between its nodes through its own part), then costs
go from the origins up to the top and from there down to every node, as array operations over
origins. A network without small separators has large fronts and is still searched exactly.
"""

from __future__ import annotations

import numpy as np

#: Parts of up to so many nodes are not divided.
LEAF = 40


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each i in turn, count[i] numbers."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component; edges a, b go both ways."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, label[a], label[b])
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _steps(n: int, starts: np.ndarray, first: np.ndarray, count: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links between each node and its part's start."""
    far, at, depth = np.full(n, -1), starts, 0
    while len(at):
        far[at] = depth
        to = b[_spans(first[at], count[at])]
        at, depth = np.unique(to[far[to] < 0]), depth + 1
    return far


def _fronts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The front of each node; a separator has a lower number than what it divides. a ascends."""
    front, made = np.full(n, -1), 0
    while (front < 0).any():
        keep = (front[a] < 0) & (front[b] < 0)
        a, b = a[keep], b[keep]
        alive = np.flatnonzero(front < 0)
        part = np.full(n, -1)
        _, part[alive], size = np.unique(_components(n, a, b)[alive], return_inverse=True, return_counts=True)
        small = size <= LEAF
        number = made + np.arange(len(size))
        made += len(size)
        front[alive[small[part[alive]]]] = number[part[alive[small[part[alive]]]]]
        nodes = np.flatnonzero(front < 0)
        if not len(nodes):
            break
        p = part[nodes]
        first = np.searchsorted(a, np.arange(n + 1))
        first, count = first[:-1], np.diff(first)

        def ends(value: np.ndarray, nodes=nodes, p=p) -> np.ndarray:
            """The node of each part with the largest value."""
            order = np.lexsort((value[nodes], p))
            return nodes[order[np.append(np.flatnonzero(np.diff(p[order])), len(order) - 1)]]

        one = ends(_steps(n, ends(np.zeros(n)), first, count, b))
        near = _steps(n, one, first, count, b)
        key = near - _steps(n, ends(near), first, count, b)
        order = np.lexsort((key[nodes], p))
        sizes = np.bincount(p, minlength=len(size))
        middle = np.zeros(len(size))
        middle[~small] = key[nodes[order[(np.cumsum(sizes) - sizes + sizes // 2)[~small]]]]
        low = np.zeros(n, bool)
        low[nodes] = key[nodes] < middle[p]
        none = np.bincount(p, weights=low[nodes], minlength=len(size)) == 0
        low[nodes] |= none[p] & (key[nodes] <= middle[p])
        cross = (front[a] < 0) & (front[b] < 0) & (low[a] != low[b])
        edge = np.zeros(n, bool)
        edge[a[cross]] = True
        below = np.bincount(p, weights=(edge & low)[nodes], minlength=len(size))
        above = np.bincount(p, weights=(edge & ~low)[nodes], minlength=len(size))
        cut = nodes[edge[nodes] & (low[nodes] == (below <= above)[p])]
        front[cut] = number[part[cut]]
    return front


class Dissection:
    """Fronts of a network in an order in which parts come before what divides them; costs are not part of it.

    place: each node's place in that order. of a front: nodes lo to hi, those below it from under, boundary.
    """

    def __init__(self, n: int, tail: np.ndarray, head: np.ndarray):
        self.n = n
        real = tail != head
        both = np.unique(np.concatenate([tail[real] * n + head[real], head[real] * n + tail[real]]).astype(np.int64))
        a, b = both // n, both % n
        _, front = np.unique(_fronts(n, a, b), return_inverse=True)
        many = int(front.max()) + 1 if n else 0
        up = front[b] < front[a]
        order = np.argsort(front[a[up]], kind="stable")
        above, edge = b[up][order], np.searchsorted(front[a[up]][order], np.arange(many + 1))
        boundary, parent, below = [None] * many, np.full(many, -1), [[] for _ in range(many)]
        for f in range(many - 1, -1, -1):
            found = np.unique(np.concatenate([above[edge[f] : edge[f + 1]], *[boundary[c] for c in below[f]]]))
            boundary[f] = found[front[found] != f]
            if len(boundary[f]):
                parent[f] = front[boundary[f]].max()
                below[parent[f]].append(f)
        # parts before what divides them, each part together
        turn, stack = [], [f for f in range(many) if parent[f] < 0]
        while stack:
            turn.append(f := stack.pop())
            stack.extend(below[f])
        turn = np.array(turn[::-1], np.int64)
        self.place = np.empty(n, np.int64)
        rank = np.empty(many, np.int64)
        rank[turn] = np.arange(many)
        self.place[np.argsort(rank[front], kind="stable")] = np.arange(n)
        size = np.bincount(front, minlength=many)[turn]
        self.hi = np.cumsum(size)
        self.lo = self.hi - size
        self.boundary = [np.sort(self.place[boundary[f]]) for f in turn]
        self.parent = np.where(parent[turn] >= 0, rank[parent[turn]], -1)
        self.under = self.lo.copy()
        for f, p in enumerate(self.parent):
            if p >= 0:
                self.under[p] = min(self.under[p], self.under[f])
        #: how many nodes the fronts above a front have, where its boundary lies among those, and the most nodes from the top down
        self.size = (self.hi - self.lo).astype(int)
        self.base = np.zeros(many, int)
        for f in range(many - 1, -1, -1):
            if self.parent[f] >= 0:
                self.base[f] = self.base[self.parent[f]] + self.size[self.parent[f]]
        at = np.repeat(self.base - self.lo, self.size) + np.arange(n)
        self.at = [at[b] for b in self.boundary]
        self.wide = int((self.base + self.size).max(initial=0))
        #: where a front's boundary lies in its parent, and links by the front that closes over them
        self.into_parent = [self.local(p, x) if p >= 0 else None for p, x in zip(self.parent, self.boundary, strict=True)]
        links = np.flatnonzero(real)
        t, h = self.place[tail[links]], self.place[head[links]]
        of = np.searchsorted(self.hi, np.minimum(t, h), side="right")
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(many + 1))
        self.links = []
        for f in range(many):
            k = order[edge[f] : edge[f + 1]]
            self.links.append((self.local(f, t[k]), self.local(f, h[k]), links[k]))

    def local(self, f: int, places: np.ndarray) -> np.ndarray:
        lo, hi = self.lo[f], self.hi[f]
        return np.where(places < hi, places - lo, hi - lo + np.searchsorted(self.boundary[f], places))


class Closed:
    """A dissection under the links' costs (inf: not usable)."""

    def __init__(self, d: Dissection, cost: np.ndarray):
        self.d, self.up, self.down = d, [], []
        waiting: dict[int, list] = {}
        for f, (lo, hi, boundary) in enumerate(zip(d.lo, d.hi, d.boundary, strict=True)):
            k = int(hi - lo)
            m = k + len(boundary)
            x = np.full((m, m), np.inf)
            t, h, link = d.links[f]
            np.minimum.at(x, (t, h), cost[link])
            for at, more in waiting.pop(f, ()):
                cells = np.ix_(at, at)
                x[cells] = np.minimum(x[cells], more)
            x[np.arange(m), np.arange(m)] = 0
            offer = np.empty_like(x)
            for p in range(k):
                np.add(x[:, p, None], x[p], out=offer)
                np.minimum(x, offer, out=x)
            if m > k:
                waiting.setdefault(int(d.parent[f]), []).append((d.into_parent[f], x[k:, k:].copy()))
            self.up.append(x[:k].copy())
            self.down.append((int(lo), int(hi), boundary.tolist(), x[k:, :k].copy()))

    def search(self, origins: np.ndarray) -> np.ndarray:
        """Least cost of each node (rows) from each origin (columns)."""
        d = self.d
        at = d.place[origins]
        order = np.argsort(at, kind="stable")
        at = at[order]
        cost = np.full((d.n, len(at)), np.inf)
        cost[at, np.arange(len(at))] = 0
        # an origin's costs go through the fronts above it only
        left, right = np.searchsorted(at, d.under), np.searchsorted(at, d.hi)
        for f in np.flatnonzero(left < right):
            i, j, lo, hi = left[f], right[f], d.lo[f], d.hi[f]
            rows = np.concatenate([np.arange(lo, hi), d.boundary[f]])
            have = cost[rows, i:j]
            best, offer = have.copy(), np.empty_like(have)
            for s, out in enumerate(self.up[f]):
                np.add(out[:, None], have[s], out=offer)
                np.minimum(best, offer, out=best)
            cost[rows, i:j] = best
        space = np.empty((int((d.hi - d.lo).max()), len(at)))
        for lo, hi, boundary, table in reversed(self.down):
            best, offer = cost[lo:hi], space[: hi - lo]
            for b, out in zip(boundary, table, strict=True):
                np.add(out[:, None], cost[b], out=offer)
                np.minimum(best, offer, out=best)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return cost[np.ix_(d.place, back)]
