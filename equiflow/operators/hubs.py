"""All-or-nothing flows of many pairs of nodes over a dissected network, without a tree an origin.

Every path between two nodes meets the fronts above both of them. A node's label holds its exact
least costs to and from the nodes of all fronts above it and of its own; a pair's cost is the least sum
of two labels over the fronts that both have, and its flow goes to that hub and on from there. Flows
between nodes and hubs are then handed up to boundaries from front to front, added up, and last
taken apart into the shortcuts and links that the fronts' costs are made of.
"""

from __future__ import annotations

import numpy as np

from .hierarchy import Dissection

#: Numbers of a table that is worked on at a time.
CELLS = 1 << 17


def _least(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """min over j of first[i, j] + then[j, a]."""
    best = np.full((len(first), then.shape[1]), np.inf)
    offer = np.empty_like(best)
    for j, row in enumerate(then):
        np.add(first[:, j, None], row, out=offer)
        np.minimum(best, offer, out=best)
    return best


def _through(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where a[i[n]] + b[j[n]] is least, of each n."""
    out, few = np.empty(len(i), np.int64), max(1, CELLS // max(1, a.shape[1]))
    for n in range(0, len(i), few):
        out[n : n + few] = (a[i[n : n + few]] + b[j[n : n + few]]).argmin(1)
    return out


class Hubs:
    """A dissection under the links' costs (inf: not usable), none of them below 0.

    They may be as unequal as they like: a path is put together from shortcuts that only ever get
    cheaper, so a link whose cost is lost in a sum can't lead in a circle.
    """

    def __init__(self, d: Dissection, cost: np.ndarray):
        self.d, self.links = d, len(cost)
        many, self.size, self.base, self.at, self.wide = len(d.lo), d.size, d.base, d.at, d.wide
        #: costs between a front's nodes and boundary through its part, the last node put in between, and what a cost was before: a link, or -2 - the front below
        self.x, self.mid, self.source, self.below = [], [], [], [[] for _ in range(many)]
        self.kept: dict[int, tuple] = {}
        for f in range(many):
            k = self.size[f]
            m = k + len(d.boundary[f])
            x, mid, source = np.full((m, m), np.inf), np.full((m, m), -1, np.int16 if k < 1 << 15 else np.int32), np.full((m, m), -1, np.int32)
            t, h, link = d.links[f]
            order = np.lexsort((-link, -cost[link]))  # of parallel links the cheapest and first comes last
            x[t[order], h[order]], source[t[order], h[order]] = cost[link[order]], link[order]
            for c in self.below[f]:
                cells, more = np.ix_(d.into_parent[c], d.into_parent[c]), self.x[c][self.size[c] :, self.size[c] :]
                source[cells] = np.where(more < x[cells], -2 - c, source[cells])
                x[cells] = np.minimum(x[cells], more)
            x[np.arange(m), np.arange(m)] = 0
            offer, better = np.empty_like(x), np.empty(x.shape, bool)
            for p in range(k):
                np.add(x[:, p, None], x[p], out=offer)
                np.less(offer, x, out=better)
                np.copyto(x, offer, where=better)
                np.copyto(mid, p, where=better)
            self.x.append(x)
            self.mid.append(mid)
            self.source.append(source)
            if d.parent[f] >= 0:
                self.below[d.parent[f]].append(f)

    def _enter(self, f: int, to: bool, from_: bool) -> None:
        """Labels of a front's nodes, which come after those of the fronts above it: w from them, v to them.

        Fronts with none below have whole ones only where asked for; else to or from their boundary.
        """
        x, k, base, at, w, v = self.x[f], self.size[f], self.base[f], self.at[f], self.w, self.v
        end, own = base + k, x[:k, :k]
        if f in self.kept:
            w[base:end, :end], v[base:end, :end] = self.kept[f]
            w[:base, base:end], v[:base, base:end] = v[base:end, :base].T, w[base:end, :base].T
            return
        if base:
            for whole, side, a, b in ((to, x[:k, k:], w, v), (from_, x[k:, :k].T, v, w)):
                if whole or self.below[f]:
                    a[base:end, :base] = _least(side, a[at, :base])
                    b[:base, base:end] = a[base:end, :base].T
                else:
                    a[base:end, at] = _least(side, a[np.ix_(at, at)])
                    b[at, base:end] = a[base:end, at].T
            own = np.minimum(own, _least(x[:k, k:], w[at, base:end]))
        w[base:end, base:end], v[base:end, base:end] = own, own.T
        if self.below[f]:
            self.kept[f] = w[base:end, :end].copy(), v[base:end, :end].copy()

    def _visits(self, to=None, from_=None, leave=None):
        """Fronts in turn, those above first, with labels made; yields (front, those above and itself).

        to, from_: the fronts that need whole labels; leave: called at the end of a front's part.
        """
        self.w, self.v = np.full((self.wide, self.wide), np.inf), np.full((self.wide, self.wide), np.inf)
        chain: list[int] = []
        for f in range(len(self.size) - 1, -1, -1):
            while chain and chain[-1] != self.d.parent[f]:
                gone = chain.pop()
                leave and leave(gone)
            self._enter(f, to is not None and to[f], from_ is not None and from_[f])
            chain.append(f)
            yield f, chain
        while chain:
            gone = chain.pop()
            leave and leave(gone)

    def load(self, origin: np.ndarray, node: np.ndarray, volume: np.ndarray, far: float) -> tuple[np.ndarray, float]:
        """(flow of each link, sum of volumes times least costs) of pairs (positions) that are nearer than ``far``."""
        d = self.d
        from_, to = d.place[origin], d.place[node]
        order = np.argsort(to, kind="stable")
        to, q = to[order], np.asarray(volume, float)[order]
        seen = np.zeros(d.n, bool)
        seen[from_] = True
        starts, o = np.flatnonzero(seen), (np.cumsum(seen) - 1)[from_[order]]
        first, last = np.searchsorted(starts, d.lo), np.searchsorted(starts, d.hi)
        lo, hi = np.searchsorted(to, d.lo), np.searchsorted(to, d.hi)
        up = np.empty((len(starts), self.wide))
        for f, _ in self._visits(to=first < last):
            base, end = self.base[f], self.base[f] + self.size[f]
            some = slice(first[f], last[f])
            up[some, :end] = self.w[base + starts[some] - d.lo[f], :end]
        least, out_of, into = 0.0, np.zeros((len(starts), self.wide)), {}
        for f, chain in self._visits(from_=lo < hi):
            i, j = lo[f], hi[f]
            if i == j:
                continue
            # labels of a pair's nodes agree as far as the lowest front above both
            base, end = self.base[f], self.base[f] + self.size[f]
            start = starts[o[i:j]]
            both = np.minimum(np.searchsorted(d.under[chain], start, side="right"), len(chain) - np.searchsorted(d.hi[chain[::-1]], start, side="right"))
            by = np.argsort(both, kind="stable")
            edge = np.searchsorted(both[by], np.arange(1, len(chain) + 2))
            arriving = np.zeros((self.size[f], end))
            for depth, c in enumerate(chain):
                long = self.base[c] + self.size[c]
                few = max(1, CELLS // long)
                for n in range(edge[depth], edge[depth + 1], few):
                    pair = i + by[n : min(n + few, edge[depth + 1])]
                    a, b = o[pair], to[pair] - d.lo[f]
                    sums = up[a, :long]
                    sums += self.v[base + b, :long]
                    hub = sums.argmin(1)
                    cost = sums[np.arange(len(pair)), hub]
                    ok = cost < far
                    a, b, hub, part = a[ok], b[ok], hub[ok], q[pair[ok]]
                    least += float(part @ cost[ok])
                    np.add.at(out_of.reshape(-1), a * self.wide + hub, part)
                    np.add.at(arriving.reshape(-1), b * end + hub, part)
            into[f] = (cells := np.flatnonzero(arriving)), arriving.reshape(-1)[cells]
        del up
        return self._links(self._handed_up(out_of, into, starts, first, last)), least

    def _handed_up(self, out_of: np.ndarray, into: dict, starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Flows on the costs within each front: what goes beyond it passes its boundary."""
        d, flow, shortcuts = self.d, np.zeros((self.wide, self.wide)), [None] * len(self.size)

        def leave(f: int) -> None:
            x, k, base, at, w, v = self.x[f], self.size[f], self.base[f], self.at[f], self.w, self.v
            end, m = base + k, len(x)
            some = slice(first[f], last[f])
            flow[base + starts[some] - d.lo[f], :end] += out_of[some, :end]
            if f in into:
                cells, more = into[f]
                flow[cells % end, base + cells // end] += more
            flow[np.arange(base, end), np.arange(base, end)] = 0
            made = np.zeros((m, m))
            own = flow[base:end, base:end]
            inside = x[:k, :k] <= w[base:end, base:end]
            made[:k, :k] = np.where(inside, own, 0)
            if base:
                out, in_ = np.ascontiguousarray(x[:k, k:]), np.ascontiguousarray(x[k:, :k].T)
                beyond, before = w[at, :end].T.copy(), v[at, :end].T.copy()
                a, b = np.nonzero(np.where(inside, 0, own))
                i = _through(out, a, beyond, base + b)
                some = own[a, b]
                np.add.at(made, (a, k + i), some)
                np.add.at(flow, (at[i], base + b), some)
                a, b = np.nonzero(flow[base:end, :base])
                i, some = _through(out, a, beyond, b), flow[base + a, b]
                np.add.at(made, (a, k + i), some)
                np.add.at(flow, (at[i], b), some)
                b, a = np.nonzero(flow[:base, base:end])
                i, some = _through(in_, a, before, b), flow[b, base + a]
                np.add.at(made, (k + i, a), some)
                np.add.at(flow, (b, at[i]), some)
            flow[base:end, :end] = 0
            flow[:base, base:end] = 0
            shortcuts[f] = made

        for _ in self._visits(leave=leave):
            pass
        return shortcuts

    def _links(self, shortcuts: list[np.ndarray]) -> np.ndarray:
        """Flows of links from those of shortcuts."""
        out = np.zeros(self.links)
        for f in range(len(self.size) - 1, -1, -1):
            flow, mid, source = shortcuts[f], self.mid[f], self.source[f]
            shortcuts[f] = None
            part, at_mid = np.empty_like(flow), np.empty(flow.shape, bool)
            while ((mid >= 0) & (flow > 0)).any():  # once, but for rounding
                for p in range(self.size[f] - 1, -1, -1):
                    np.equal(mid, p, out=at_mid)
                    np.multiply(flow, at_mid, out=part)
                    flow -= part
                    flow[:, p] += part.sum(1)
                    flow[p] += part.sum(0)
            for c in self.below[f]:
                cells, k = np.ix_(self.d.into_parent[c], self.d.into_parent[c]), self.size[c]
                shortcuts[c][k:, k:] += np.where(source[cells] == -2 - c, flow[cells], 0)
            i, j = np.nonzero((source >= 0) & (flow > 0))
            np.add.at(out, source[i, j], flow[i, j])
        return out
