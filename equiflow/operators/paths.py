"""Shortest paths and network loading: graph search in Arrow-fed tasks, parallel by origin.

The network (links, at most some hundred thousand) is collected once and broadcast; origins and
demand stay distributed. What a task returns is per link, so flows are summed before and after
the shuffle and never depend on the number of trips. A network is searched from many origins at a
time by array operations: a small one link by link, a large one by nested dissection. Under turn bans,
nodes that carry no trips on or links without cost a large one is searched by a heap from each origin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import Closed, Dissection

FAR = 9_999_999.0
#: Networks of up to so many states (nodes, or links under turn bans) are searched by arrays; cells held at a time.
ARRAY_STATES, ARRAY_CELLS = 200, 2_000_000
#: Costs of origins and nodes of a larger network held at a time, and networks closed under their costs.
CELLS, HELD_CLOSED = 16_000_000, 6
#: Paths whose costs differ by less than this share, as sums in another order do, are alike: the first link is taken.
ALIKE = 1e-12
#: Rows of an Arrow batch that a task returns, and steps of a walk after which what goes over one link is added up.
ROWS, MERGED = 250_000, 8


class Graph:
    """Forward adjacency over positions of nodes; ``banned`` holds (in link, out link) positions."""

    def __init__(self, link_id, tail, head, cost, first_thru: int = -1, banned: set | None = None):
        self.nodes = np.unique(np.concatenate([tail, head]))
        self.index = {int(n): i for i, n in enumerate(self.nodes)}
        self.link_id, self.cost = np.asarray(link_id), np.asarray(cost)
        self.tail, self.head = np.searchsorted(self.nodes, tail), np.searchsorted(self.nodes, head)
        order = np.lexsort((self.head, self.tail))
        self.out = [[] for _ in self.nodes]
        for k in order:
            self.out[self.tail[k]].append((int(self.head[k]), int(k)))
        # nodes below first_thru end trips but don't carry them on
        self.through = self.nodes >= first_thru if first_thru > 0 else np.ones(len(self.nodes), bool)
        self.banned = banned or set()

    def positions(self, ids: np.ndarray) -> np.ndarray:
        """Of nodes by their numbers; -1 for a number that is no node's."""
        if not len(self.nodes):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        return np.where(self.nodes[at] == ids, at, -1)

    @property
    def together(self) -> int:
        """Origins that are searched at a time."""
        return max(16, min(256, CELLS // max(1, len(self.nodes))))

    @property
    def tasks(self) -> int:
        """Tasks that a search from most nodes is dealt to."""
        return max(1 + len(self.nodes) // 192, min(16, len(self.nodes) // 64))

    def dissected(self) -> Graph:
        """This graph, with its dissection if searches can use it: before it is sent to the tasks."""
        if len(self.nodes) > ARRAY_STATES and not self.banned and self.through.all() and not hasattr(self, "dissection"):
            self.dissection, self.closed = Dissection(len(self.nodes), self.tail, self.head), {}
            # links into a node, by how many come before: (as many nodes of most links first, those links)
            order = np.lexsort((np.arange(len(self.head)), self.head))
            degree = np.bincount(self.head, minlength=len(self.nodes))
            self.most_first = np.argsort(-degree, kind="stable")
            start, degree = (np.cumsum(degree) - degree)[self.most_first], degree[self.most_first]
            self.incoming = [order[start[degree > j] + j] for j in range(int(degree.max()) if len(degree) else 0)]
        return self

    def tree(self, origin: int, usable: np.ndarray | None = None, cost: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cost, link into) of each node from the origin's position; -1 where there is no link."""
        c = self.cost if cost is None else cost
        dist, into = np.full(len(self.nodes), np.inf), np.full(len(self.nodes), -1, np.int64)
        dist[origin], heap = 0, [(0, origin)]
        while heap:
            d, n = heapq.heappop(heap)
            if d > dist[n] or (n != origin and not self.through[n]):
                continue
            for to, k in self.out[n]:
                if (usable is None or usable[k]) and d + c[k] < dist[to]:
                    dist[to], into[to] = d + c[k], k
                    heapq.heappush(heap, (dist[to], to))
        return dist, into

    def turn_tree(self, origin: int, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact under banned turns: states are links. (cost of node, link into node, link before link)."""
        at_link, before = np.full(len(self.link_id), np.inf), np.full(len(self.link_id), -1, np.int64)
        dist, into, heap = np.full(len(self.nodes), np.inf), np.full(len(self.nodes), -1, np.int64), []
        dist[origin] = 0
        for _, k in self.out[origin]:
            if usable is None or usable[k]:
                at_link[k] = self.cost[k]
                heapq.heappush(heap, (at_link[k], k))
        while heap:
            d, k = heapq.heappop(heap)
            if d > at_link[k]:
                continue
            n = self.head[k]
            if d < dist[n]:
                dist[n], into[n] = d, k
            if not self.through[n]:
                continue
            for _, j in self.out[n]:
                if (usable is None or usable[j]) and (k, j) not in self.banned and d + self.cost[j] < at_link[j]:
                    at_link[j], before[j] = d + self.cost[j], k
                    heapq.heappush(heap, (at_link[j], j))
        return dist, into, before

    def trace(self, into: np.ndarray, node: int, before: np.ndarray | None = None) -> list[int]:
        path, k = [], into[node]
        while k >= 0 and len(path) <= len(self.link_id):
            path.append(int(k))
            k = into[self.tail[k]] if before is None else before[k]
        return path[::-1]

    def _states(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from state, to state, link) of every step under turn bans; a state is the link just used."""
        if not hasattr(self, "steps"):
            a = [(k, j) for k in range(len(self.link_id)) for _, j in self.out[self.head[k]] if (k, j) not in self.banned]
            self.steps = np.array(a, np.int64).reshape(-1, 2).T
        return self.steps[0], self.steps[1], self.steps[1]

    def forest(self, origins: np.ndarray, usable: np.ndarray | None = None, cost: np.ndarray | None = None, links: bool = True) -> Forest:
        """The trees of many origins (positions); without ``links`` their costs may be all that is found."""
        c = np.asarray(self.cost if cost is None else cost)
        ok = np.ones(len(c), bool) if usable is None else usable
        if max(len(self.nodes), len(self.link_id) if self.banned else 0) <= ARRAY_STATES:
            return self._array_forest(origins, ok, c)
        n, many = len(self.nodes), len(origins)
        if hasattr(self, "dissection") and (found := self._dissected_forest(origins, ok, c, links)):
            return found
        dist, into = np.empty((many, n)), np.empty((many, n), np.int64)
        before = np.full((many, len(c)), -1, np.int64) if self.banned else None
        for i, o in enumerate(origins):
            if self.banned:
                held, self.cost = self.cost, c
                dist[i], into[i], before[i] = self.turn_tree(int(o), ok)
                self.cost = held
            else:
                dist[i], into[i] = self.tree(int(o), ok, c)
        return Forest(self, dist, into, before)

    def _dissected_forest(self, origins: np.ndarray, ok: np.ndarray, c: np.ndarray, links: bool) -> Forest | None:
        """None where sums of costs may not tell which of two nodes comes first."""
        c, whole = np.where(ok, c, np.inf), c.dtype.kind == "i"
        if not c.min(initial=np.inf) > 0 or not whole and c.min() < 4 * ALIKE * len(self.nodes) * c.max(where=np.isfinite(c), initial=0.0):
            return None
        key = c.tobytes()
        if key not in self.closed:
            if len(self.closed) >= HELD_CLOSED:
                self.closed.pop(next(iter(self.closed)))
            self.closed[key] = Closed(self.dissection, c)
        dist = self.closed[key].search(np.asarray(origins))
        if whole and dist.max(where=np.isfinite(dist), initial=0.0) >= 1 << 52:
            return None
        if not links:
            return Forest(self, dist.T, None, None)
        into = np.full(dist.shape, -1, np.int32)
        for i in range(0, len(self.nodes), 512):  # nodes at a time
            nodes = self.most_first[i : i + 512]
            best, link = np.full((len(nodes), len(origins)), np.inf), np.full((len(nodes), len(origins)), -1, np.int32)
            for more in self.incoming:
                k = more[i : i + 512]
                if not len(k):
                    break
                offer = dist[self.tail[k]] + c[k, None]
                better = offer < (best[: len(k)] if whole else best[: len(k)] * (1 - ALIKE))
                np.copyto(link[: len(k)], k[:, None].astype(np.int32), where=better)
                np.minimum(best[: len(k)], offer, out=best[: len(k)])
            into[nodes] = link
        into[origins, np.arange(len(origins))] = -1
        return Forest(self, np.ascontiguousarray(dist.T), np.ascontiguousarray(into.T), None)

    def _array_forest(self, origins: np.ndarray, ok: np.ndarray, c: np.ndarray) -> Forest:
        n, m, many = len(self.nodes), len(c), len(origins)
        rows = np.arange(many)
        if self.banned:
            a, b, via = self._states()
            keep = ok[via] & self.through[self.head[a]] & ok[a]
            start = np.full((many, m), np.inf)
            first = np.flatnonzero(ok)
            mine = self.tail[first][None, :] == np.asarray(origins)[:, None]
            start[:, first] = np.where(mine, c[first], np.inf)
            at_link, before = _relax(start, a[keep], b[keep], c[via[keep]].astype(float), a[keep])
            order = np.lexsort((np.arange(m), self.head))
            dist, into = np.full((many, n), np.inf), np.full((many, n), -1, np.int64)
            for k in order:  # links, not trips
                better = at_link[:, k] < dist[:, self.head[k]]
                dist[better, self.head[k]], into[better, self.head[k]] = at_link[better, k], k
            dist[rows, origins], into[rows, origins] = 0, -1
            return Forest(self, dist, into, before)
        start = np.full((many, n), np.inf)
        start[rows, origins] = 0
        links = np.flatnonzero(ok)
        gate = None if self.through.all() else (self.through[self.tail[links]][None, :] | (self.tail[links][None, :] == np.asarray(origins)[:, None]))
        dist, into = _relax(start, self.tail[links], self.head[links], c[links].astype(float), links, gate)
        into[rows, origins] = -1
        return Forest(self, dist, into, None)


def _relax(start: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, label: np.ndarray, gate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from start (rows: searches, columns: states) over steps a -> b of cost c, and the label of the step into each."""
    order = np.argsort(b, kind="stable")
    a, b, c, label = a[order], b[order], c[order], label[order]
    heads, first = np.unique(b, return_index=True)
    length = np.diff(first, append=len(b))
    dist, into = start.copy(), np.full(start.shape, -1, np.int64)
    if gate is not None:
        gate = gate[:, order]
    # bounds which columns one pass holds
    part = max(1, ARRAY_CELLS // max(1, len(b)))
    for i in range(0, len(dist), part):
        d, t = dist[i : i + part], into[i : i + part]
        while len(b):
            offer = d[:, a] + c
            if gate is not None:
                offer = np.where(gate[i : i + part], offer, np.inf)
            best = np.minimum.reduceat(offer, first, axis=1)
            better = best < d[:, heads]
            if not better.any():
                break
            wide = np.repeat(best, length, axis=1)
            place = np.where(offer == wide, np.arange(len(b)), len(b))
            which = np.minimum.reduceat(place, first, axis=1)
            r, k = np.nonzero(better)
            d[r, heads[k]] = best[r, k]
            t[r, heads[k]] = label[np.minimum(which[r, k], len(b) - 1)]
    return dist, into


class Forest:
    """Trees of several origins: cost and link into each node, and under turn bans the link before each link."""

    def __init__(self, graph: Graph, dist: np.ndarray, into: np.ndarray | None, before: np.ndarray | None):
        self.graph, self.dist, self.into, self.before = graph, dist, into, before

    def path(self, i: int, node: int) -> list[int]:
        return self.graph.trace(self.into[i], node, None if self.before is None else self.before[i])

    def flows(self, i: np.ndarray, node: np.ndarray, volume: np.ndarray) -> np.ndarray:
        """Volume of every link when each (tree, node) sends its volume along its path."""
        g = self.graph
        out = np.zeros(len(g.link_id))
        link = self.into[i, node]
        i, q = i[link >= 0], volume[link >= 0]
        link = link[link >= 0]
        for step in range(len(g.link_id) + 1):
            if not len(link):
                break
            if step % MERGED == 0:  # what goes over one link of one tree goes on together
                key, of = np.unique(i.astype(np.int64) * len(g.link_id) + link, return_inverse=True)
                q = np.bincount(of, weights=q, minlength=len(key))
                i, link = key // len(g.link_id), key % len(g.link_id)
            np.add.at(out, link, q)
            link = self.into[i, g.tail[link]] if self.before is None else self.before[i, link]
            on = link >= 0
            i, q, link = i[on], q[on], link[on]
        return out

    def walks(self, i: np.ndarray, node: np.ndarray, miles: np.ndarray, routes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Links and miles of the path to each (tree, node), and the links of all paths in turn if asked for."""
        g = self.graph
        hops, length, steps = np.zeros(len(i), np.int64), np.zeros(len(i)), []
        row, link = np.arange(len(i)), self.into[i, node].astype(np.int64)
        for _ in range(len(g.link_id) + 1):
            on = link >= 0
            row, link = row[on], link[on]
            if not len(link):
                break
            hops[row] += 1
            length[row] += miles[link]
            if routes:
                steps.append((row, link))
            tree = i[row]
            link = (self.into[tree, g.tail[link]] if self.before is None else self.before[tree, link]).astype(np.int64)
        if not routes:
            return hops, length, None
        last, path = np.cumsum(hops) - 1, np.empty(int(hops.sum()), np.int64)
        for k, (row, link) in enumerate(steps):
            path[last[row] - k] = link
        return hops, length, path


def graph_of(links: DataFrame, cost: str = "cost", first_thru: int = -1, bans: DataFrame | None = None) -> Graph:
    """Collects the network: one row a link, so its size is that of the road system, not of the demand."""
    rows = links.select("link_id", "from_node_id", "to_node_id", F.col(cost).alias("c")).orderBy("from_node_id", "to_node_id", "link_id").toPandas()
    banned = set()
    if bans is not None:
        where = {int(v): i for i, v in enumerate(rows.link_id)}
        banned = {(where[a], where[b]) for a, b in bans.select("ib_link_id", "ob_link_id").toPandas().itertuples(index=False) if a in where and b in where}
    return Graph(rows.link_id.to_numpy(), rows.from_node_id.to_numpy(), rows.to_node_id.to_numpy(), rows.c.to_numpy(), first_thru, banned)


def skim(links: DataFrame, origins: DataFrame, cost: str = "cost", first_thru: int = -1, bans: DataFrame | None = None, floor: float | None = None, pairs: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(o, d, cost): the least cost of every reachable pair. origins: one column o.

    Links cost at least ``floor``; ``pairs`` (o, d) keeps only those; costs are rounded to ``digits``.
    """
    if floor is not None:
        links = links.withColumn(cost, F.greatest(F.col(cost), F.lit(floor)))
    g = graph_of(links, cost, first_thru, bans).dissected()
    kind = "long" if g.cost.dtype.kind == "i" else "double"
    held = links.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        for b in batches:
            ids = np.array([o for o in b.column(0).to_pylist() if o in g.index], np.int64)
            for k in range(0, len(ids), g.together):
                part = ids[k : k + g.together]
                dist = g.forest(np.searchsorted(g.nodes, part), links=False).dist.T
                few = max(1, ROWS // len(part))
                for j in range(0, len(g.nodes), few):  # by node: written ids then take next to no room
                    c = dist[j : j + few]
                    o, d = np.tile(part, len(c)), np.repeat(g.nodes[j : j + few].astype(np.int64), len(part))
                    c = c.ravel()
                    if not (ok := np.isfinite(c)).all():
                        o, d, c = o[ok], d[ok], c[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(d), pa.array(c.astype(np.int64) if kind == "long" else c)], names=["o", "d", "cost"])

    # the number of tasks is given, as few origins make much work
    out = origins.select(F.col("o").cast("long").alias("o")).distinct().repartition(g.tasks, "o").mapInArrow(run, f"o long, d long, cost {kind}")
    if pairs is not None:
        out = out.join(pairs.select("o", "d").distinct(), ["o", "d"], "left_semi")
    return out if digits is None else out.withColumn("cost", F.round("cost", digits))


def usable_links(allowed: np.ndarray, mode: str) -> np.ndarray:
    """A class may use a link whose allowed_use is empty or ``all``, or holds its name."""
    return np.array([a == "" or a == "all" or mode in a for a in allowed])


def load(links: DataFrame, demand: DataFrame, cost: str = "cost", *, modes: bool = True, first_thru: int = -1, bans: DataFrame | None = None, undedicated: tuple = (), leader: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing: (link flows: mode, link_id, flow; pairs: mode, o, d, volume, cost, links, miles).

    demand: mode, o, d, volume. With ``modes`` each class keeps to links it may use; the classes in
    ``undedicated`` take the paths of class ``leader``. Pairs without a path have a null cost, no links.
    """
    flows = load_flows(links, demand, cost, modes=modes, first_thru=first_thru, bans=bans, undedicated=undedicated, leader=leader)
    return flows, load_pairs(links, demand, cost, modes=modes, first_thru=first_thru, bans=bans, undedicated=undedicated, leader=leader)


def _searching(links: DataFrame, demand: DataFrame, cost: str, modes: bool, first_thru: int, bans: DataFrame | None, undedicated: tuple, leader: str | None):
    """(broadcast graph with the links' use and length, rows of one origin and class with destinations d and volumes q, search)."""
    g = graph_of(links, cost, first_thru, bans).dissected()
    has = [c for c in ("allowed_use", "length") if c in links.columns]
    table = links.select("link_id", "from_node_id", "to_node_id", *has).orderBy("from_node_id", "to_node_id", "link_id").toPandas()
    allowed = table.allowed_use.fillna("").to_numpy() if "allowed_use" in has else np.full(len(table), "")
    miles = table.length.to_numpy() if "length" in has else np.zeros(len(table))
    held = links.sparkSession.sparkContext.broadcast((g, allowed, miles))
    trips = demand.filter((F.col("volume") > 1e-6) & (F.col("o") != F.col("d")))
    # an origin's classes are in one task, as those that may use the same links share its tree
    work = trips.repartition(g.tasks, "o").groupBy("o", "mode").agg(F.collect_list("d").alias("d"), F.collect_list("volume").alias("q"))

    def search(batch: pd.DataFrame) -> Iterator[tuple]:
        """(graph, miles, forest, rows of o, mode, d, q, tree of each row) of some origins at a time; tree -1: the origin is no node."""
        g, allowed, miles = held.value
        use = {m: usable_links(allowed, leader if m in undedicated else m) if modes else None for m in batch["mode"].unique()}
        alike = batch["mode"].map({m: b"" if u is None else u.tobytes() for m, u in use.items()})
        for _, rows in batch.groupby(alike, sort=False):
            usable = use[rows["mode"].iloc[0]]
            origins = [o for o in rows.o.unique()]
            for k in range(0, len(origins), g.together):
                ids = origins[k : k + g.together]
                known = [o for o in ids if o in g.index]
                forest = g.forest(np.array([g.index[o] for o in known], np.int64), usable) if known else None
                part = rows[rows.o.isin(ids)]
                tree = part.o.map({o: i for i, o in enumerate(known)}).fillna(-1).astype(int).to_numpy()
                yield g, miles, forest, part, tree

    return work, search


def load_flows(links: DataFrame, demand: DataFrame, cost: str = "cost", *, modes: bool = True, first_thru: int = -1, bans: DataFrame | None = None, undedicated: tuple = (), leader: str | None = None) -> DataFrame:
    """mode, link_id, flow; each task sums its links before anything is sent."""
    work, search = _searching(links, demand, cost, modes, first_thru, bans, undedicated, leader)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flow, ids = {}, None
        for b in batches:
            for g, _, forest, part, tree in search(b):
                ids = g.link_id
                for mode in part["mode"].unique():
                    mine = (part["mode"] == mode).to_numpy() & (tree >= 0)
                    if not mine.any():
                        continue
                    rows = part[mine]
                    i, d, q = np.repeat(tree[mine], rows.d.map(len).to_numpy()), np.concatenate(rows.d.to_numpy()), np.concatenate(rows.q.to_numpy())
                    node = g.positions(d)
                    ok = node >= 0
                    flow[mode] = flow.get(mode, 0.0) + forest.flows(i[ok], node[ok], q[ok])
        for mode, f in flow.items():
            at = np.flatnonzero(f)
            yield pd.DataFrame({"mode": mode, "link_id": ids[at], "flow": f[at]})

    return work.mapInPandas(run, "mode string, link_id long, flow double").groupBy("mode", "link_id").agg(F.sum("flow").alias("flow"))


def load_pairs(links: DataFrame, demand: DataFrame, cost: str = "cost", *, modes: bool = True, first_thru: int = -1, bans: DataFrame | None = None, undedicated: tuple = (), leader: str | None = None, routes: bool = True) -> DataFrame:
    """mode, o, d, volume, cost, links, miles of every demanded pair; miles are summed along the path in the task.

    Without ``routes`` hops, the number of links, stands in place of links.
    """
    work, search = _searching(links, demand, cost, modes, first_thru, bans, undedicated, leader)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, miles, forest, part, tree in search(b.to_pandas()):
                many = part.d.map(len).to_numpy()
                d, q, i, row = np.concatenate(part.d.to_numpy()), np.concatenate(part.q.to_numpy()), np.repeat(tree, many), np.repeat(np.arange(len(part)), many)
                mode, o = pa.array(part["mode"], pa.string()), part.o.to_numpy()
                node = g.positions(d)
                for at in range(0, len(d), ROWS // 16):
                    s = slice(at, at + ROWS // 16)
                    c = np.full(len(d[s]), np.inf)
                    known = (node[s] >= 0) & (i[s] >= 0)
                    if forest:
                        c[known] = forest.dist[i[s][known], node[s][known]]
                    ok = np.isfinite(c)
                    hops, length, path = forest.walks(i[s][ok], node[s][ok], miles, routes) if ok.any() else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
                    far, count = np.zeros(len(c)), np.zeros(len(c), np.int64)
                    far[ok], count[ok] = length, hops
                    if routes:
                        ends = np.append(0, np.cumsum(count)).astype(np.int32)
                        how = pa.ListArray.from_arrays(pa.array(ends), pa.array(g.link_id[path].astype(np.int64)), mask=pa.array(~ok))
                    else:
                        how = pa.array(count, mask=~ok)
                    yield pa.RecordBatch.from_arrays([mode.take(pa.array(row[s])), pa.array(o[row[s]].astype(np.int64)), pa.array(d[s].astype(np.int64)), pa.array(q[s].astype(float)), pa.array(c, mask=~ok), how, pa.array(far, mask=~ok)], names=["mode", "o", "d", "volume", "cost", "how", "miles"])

    how = "links array<long>" if routes else "hops long"
    return work.mapInArrow(run, f"mode string, o long, d long, volume double, cost double, {how}, miles double")
