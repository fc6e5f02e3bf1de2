"""Static user equilibrium by the Frank-Wolfe family.

An iteration is one Spark job (loading, parallel by class and origins, summed per link); where trips
times links are few it is done on the driver, as a job's latency would be all its time. A dissected
network is loaded pair by pair through hubs (``operators/hubs.py``), others along trees of origins.
Link vectors are as long as the network and stay on the driver; step sizes come from the grid of
1/32 that bisection with five halvings can reach.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vdf
from .hubs import Hubs
from .paths import FAR, Graph, usable_links

#: Demand rows, and origins and classes times links, up to which iterations run on the driver.
DRIVER_PAIRS, DRIVER_STEPS = 200_000, 5_000_000
#: Numbers in the labels of a task's origins, tasks at least, and pairs that a task loads at a time.
LABELS, LEAST_TASKS, PAIRS = 1 << 26, 4, 1 << 24


@dataclass
class Settings:
    iterations: int = 20
    hours: float = 1.0
    first_thru: int = -1
    method: str = "fw"  # fw, cfw or bfw
    gap_target: float | None = None
    consecutive: int = 1
    added_per_mile: float = 0.0
    gap_by_total: bool = False  # gap over the current total instead of the least one


@dataclass
class Result:
    links: pd.DataFrame
    gaps: list[float] = field(default_factory=list)
    steps: list[float] = field(default_factory=list)

    def to_pandas(self) -> pd.DataFrame:
        return self.links

    def summary(self) -> dict:
        """Links, loaded links, vehicle miles and hours, and the last gap."""
        v = self.links
        return {"links": len(v), "loaded": int((v.volume > 0).sum()), "VMT": float((v.volume * v.length).sum()), "VHT": float((v.volume * v.travel_time).sum() / 60), "gap_percent": self.gaps[-1] if self.gaps else None}

    def shares(self) -> list[float]:
        """Share of each iteration's routes in the final flows (plain Frank-Wolfe)."""
        out = [1.0]
        for s in self.steps:
            out = [x * (1 - s) for x in out] + [s]
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.links)


def line_step(slope) -> float:
    """Bisection on the slope at 0..1: 0 or 1 at an end of one sign, else the left end after five halvings."""
    if slope(0.0) >= 0:
        return 0.0
    if slope(1.0) <= 0:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(5):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) < 0 else (low, mid)
    return low


class Problem:
    """bans: (ib_link_id, ob_link_id) that may not follow each other. base: columns base_volume, or
    base_vol_<class>, of links hold volumes that the first loading adds to."""

    def __init__(self, links: DataFrame, demand: DataFrame, modes: DataFrame, settings: Settings, bans: DataFrame | None = None):
        self.s = settings
        self.links = links.orderBy("from_node_id", "to_node_id", "link_id").toPandas()
        self.modes = modes.orderBy("k").toPandas()
        v = self.links
        self.fixed = {m.mode: vdf.generalized_minutes(v.toll.to_numpy(), v.length.to_numpy(), m.operating_cost, m.vot) for m in self.modes.itertuples()}
        self.usable = {m: usable_links(v.allowed_use.fillna("").to_numpy(), m) for m in self.modes["mode"]}
        #: a class without paths of its own takes those of the first one
        dedicated = self.modes["dedicated"].fillna(True) if "dedicated" in self.modes else [True] * len(self.modes)
        first = self.modes["mode"].iloc[0]
        self.paths_of = {m: m if own else first for m, own in zip(self.modes["mode"], dedicated, strict=True)}
        self.pce = dict(zip(self.modes["mode"], self.modes.pce, strict=True))
        self.own = {n: v[n].to_numpy() for n in vdf.DEFAULTS if n in v}
        banned = set()
        if bans is not None:
            where = {int(x): i for i, x in enumerate(v.link_id)}
            banned = {(where[a], where[b]) for a, b in bans.select("ib_link_id", "ob_link_id").toPandas().itertuples(index=False) if a in where and b in where}
        self.graph = Graph(v.link_id.to_numpy(), v.from_node_id.to_numpy(), v.to_node_id.to_numpy(), np.zeros(len(v)), settings.first_thru, banned).dissected()
        self.spark = links.sparkSession
        self.held = self.spark.sparkContext.broadcast((self.graph, self.fixed, self.usable, self.paths_of, self.pce))
        self.work, self.local = self.grouped(demand)

    def grouped(self, demand: DataFrame) -> tuple[DataFrame, pd.DataFrame | None]:
        """A row per origin and class with its destinations: the unit of work in every iteration; collected if it is little."""
        trips = demand.filter((F.col("volume") > 1e-6) & (F.col("o") != F.col("d")))
        if hasattr(self.graph, "dissection"):
            # a task has one class and a share of the origins, as labels are made anew in each
            classes = list(self.fixed)
            shares = max(-(-len(self.graph.nodes) * self.graph.dissection.wide // LABELS), -(-LEAST_TASKS // len(classes)))
            number = F.coalesce(*[F.when(F.col("mode") == m, k) for k, m in enumerate(classes)])
            trips = trips.filter(number.isNotNull()).withColumn("_task", (number * shares + F.pmod("o", F.lit(shares))).cast("int")).repartitionById(len(classes) * shares, "_task")
            work = trips.groupBy("_task", "o", "mode")
        else:
            work = trips.repartition(self.graph.tasks, "o").groupBy("o", "mode")
        work = work.agg(F.collect_list("d").alias("d"), F.collect_list("volume").alias("q")).select("o", "mode", "d", "q").persist()
        rows, pairs = work.agg(F.count("*"), F.sum(F.size("d"))).first()
        small = (pairs or 0) <= DRIVER_PAIRS and rows * len(self.links) <= DRIVER_STEPS
        return work, work.toPandas() if small else None

    def times(self, volume: np.ndarray) -> np.ndarray:
        v, k = self.links, vdf.OnArrays
        _, x = vdf.demand_over_capacity(k, volume, v.lanes.to_numpy(), self.s.hours, v.plf.to_numpy(), v.capacity.to_numpy())
        return vdf.travel_time(k, v.vdf_type.to_numpy(), v.fftt.to_numpy(), x, v.alpha.to_numpy(), v.beta.to_numpy(), v.length.to_numpy(), v.free_speed.to_numpy(), hours=self.s.hours, added_per_mile=self.s.added_per_mile, **self.own)

    def load(self, times: np.ndarray, work: tuple | None = None) -> tuple[dict[str, np.ndarray], float]:
        """({class: link flows}, least total cost) of everyone on the cheapest paths."""
        rows, local = work or (self.work, self.local)
        if local is not None:
            flow, least = _loaded(local, times, self.held.value)
            return {m: flow.get(m, np.zeros(len(times))) for m in self.fixed}, least
        held, sent = self.held, self.spark.sparkContext.broadcast(times)

        def run(batches):
            flow, least = {}, 0.0
            for b in _together(batches):
                more, cost = _loaded(b, sent.value, held.value)
                least += cost
                for m, f in more.items():
                    flow[m] = flow.get(m, 0.0) + f
            for mode, f in flow.items():
                at = np.flatnonzero(f)
                yield pd.DataFrame({"mode": mode, "link": at, "flow": f[at]})
            yield pd.DataFrame({"mode": [""], "link": [-1], "flow": [least]})

        got = rows.mapInPandas(run, "mode string, link long, flow double").groupBy("mode", "link").agg(F.sum("flow").alias("flow")).toPandas()
        sent.unpersist()
        out = {m: np.zeros(len(times)) for m in self.fixed}
        for m, part in got[got.link >= 0].groupby("mode"):
            out[m][part.link.to_numpy()] = part.flow.to_numpy()
        return out, float(got[got.link < 0].flow.sum())

    def base(self) -> dict[str, np.ndarray]:
        """Volumes by class that are there before the first loading."""
        v = self.links
        if len(self.modes) == 1 and "base_volume" in v:
            return {self.modes["mode"].iloc[0]: v.base_volume.fillna(0.0).to_numpy(float)}
        return {m: v[f"base_vol_{m}"].fillna(0.0).to_numpy(float) if f"base_vol_{m}" in v else np.zeros(len(v)) for m in self.fixed}

    def total(self, by_mode: dict[str, np.ndarray]) -> np.ndarray:
        return sum(self.pce[m] * f for m, f in by_mode.items())

    def system(self, by_mode: dict[str, np.ndarray], times: np.ndarray) -> float:
        return float(sum(self.pce[m] * f @ (times + self.fixed[m]) for m, f in by_mode.items()))


def _together(batches):
    """Batches of rows with many pairs each."""
    some, pairs = [], 0
    for b in batches:
        some.append(b)
        pairs += int(b.d.map(len).sum())
        if pairs >= PAIRS:
            yield pd.concat(some)
            some, pairs = [], 0
    if some:
        yield pd.concat(some)


def _loaded(work: pd.DataFrame, times: np.ndarray, held: tuple) -> tuple[dict[str, np.ndarray], float]:
    """Link flows by class and the least cost of the rows (o, mode, d, q)."""
    graph, fixed, usable, paths_of, pce = held
    flow, least = {}, 0.0
    for mode, rows in work.groupby("mode", sort=False):
        rows = rows[rows.o.isin(graph.index)]
        of = paths_of[mode]
        cost = np.where(usable[of], times + fixed[of], np.inf)
        if hasattr(graph, "dissection") and len(rows) and cost.min(initial=np.inf) >= 0:
            d = graph.positions(np.concatenate(rows.d.to_numpy()))
            o, q = np.repeat(graph.positions(rows.o.to_numpy()), rows.d.map(len).to_numpy()), np.concatenate(rows.q.to_numpy())
            more, sums = Hubs(graph.dissection, cost).load(o[d >= 0], d[d >= 0], q[d >= 0], FAR)
            flow[mode] = flow.get(mode, 0.0) + more
            least += float(pce[mode]) * sums
            continue
        for k in range(0, len(rows), graph.together):
            part = rows.iloc[k : k + graph.together]
            forest = graph.forest(graph.positions(part.o.to_numpy()), usable[of], times + fixed[of])
            size = part.d.map(len).to_numpy()
            i = np.repeat(np.arange(len(part)), size)
            d, q = np.concatenate(part.d.to_numpy()), np.concatenate(part.q.to_numpy())
            node = graph.positions(d)
            ok = (node >= 0) & (forest.dist[i, node] < FAR)
            i, node, q = i[ok], node[ok], q[ok]
            least += float(pce[mode] * (q @ forest.dist[i, node]))
            flow[mode] = flow.get(mode, 0.0) + forest.flows(i, node, q)
    return flow, least


def assign(links: DataFrame, demand: DataFrame, modes: DataFrame, settings: Settings | None = None, bans: DataFrame | None = None, base_demand: DataFrame | None = None) -> Result:
    """Equilibrium link flows. settings.iterations counts the first loading, as N - 1 steps follow it.

    bans: turns that no path takes (``reports.turn_bans``). base_demand: the trips that the base
    volumes of the links stand for; the first loading then adds only what the demand has beyond them.
    """
    s = settings or Settings()
    p = Problem(links, demand, modes, s, bans)
    first = p.fixed[p.modes["mode"].iloc[0]]
    if base_demand is None:
        x, _ = p.load(p.times(np.zeros(len(p.links))))
    else:
        base = p.base()
        more, less = demand_difference(demand, base_demand)
        t = p.times(p.total(base))
        up, down = (p.load(t, p.grouped(part))[0] for part in (more, less))
        x = {m: np.maximum(0.0, base[m] + up[m] - down[m]) for m in p.fixed}
    gaps, steps, older, below = [], [], [], 0
    for _ in range(1, s.iterations):
        v = p.total(x)
        t = p.times(v)
        y, least = p.load(t)
        now = p.system(x, t)
        gaps.append((now - least) / max(0.1, now if s.gap_by_total else least) * 100)
        below = below + 1 if s.gap_target is not None and 0 <= gaps[-1] < s.gap_target else 0
        if below >= s.consecutive:
            break
        target = {m: y[m] for m in x}
        if s.method != "fw" and older:
            target = _conjugate(p, x, y, older[-1 if s.method == "cfw" else -2 :], steps)
        d = p.total(target) - v
        if s.method != "fw" and float((t + first) @ d) > 0:
            target, d = y, p.total(y) - v
        lam = line_step(lambda a: float((p.times(v + a * d) + first) @ d))
        older = (older + [target])[-2:]
        x = {m: x[m] + lam * (target[m] - x[m]) for m in x}
        steps.append(lam)
    p.work.unpersist()
    v = p.total(x)
    out = p.links.assign(volume=v, travel_time=p.times(v))
    for m in x:
        out[f"mod_vol_{m}"] = x[m]
    return Result(out, gaps, steps)


def demand_difference(demand: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trips beyond the base and trips that the base has beyond them, both positive; pairs that the base doesn't list count whole."""
    b = base.select("mode", "o", "d", F.col("volume").alias("base"))
    d = demand.join(b, ["mode", "o", "d"], "left").withColumn("volume", F.col("volume") - F.coalesce("base", F.lit(0.0))).drop("base")
    return d.filter("volume > 0"), d.filter("volume < 0").withColumn("volume", -F.col("volume"))


def _conjugate(p: Problem, x: dict, y: dict, older: list[dict], steps: list[float]) -> dict:
    """Directions conjugate to one (or two) before, under the diagonal slope of the times."""
    v = p.total(x)
    dv = np.maximum(1.0, 1e-4 * v)
    h = np.maximum(0.0, (p.times(v + dv) - p.times(v)) / dv)
    fw = p.total(y) - v
    last = p.total(older[-1]) - v
    down = float(last @ (h * (fw - last)))
    a = float(last @ (h * fw)) / down if abs(down) > 1e-12 else 0.0
    a = min(1 - 1e-4, max(0.0, a))
    if len(older) == 1 or not steps or steps[-1] >= 1:
        return {m: a * older[-1][m] + (1 - a) * y[m] for m in x}
    lam = steps[-1]
    before = lam * p.total(older[-1]) + (1 - lam) * p.total(older[-2]) - v
    mu_down = float(before @ (h * (p.total(older[-2]) - p.total(older[-1]))))
    mu = max(0.0, -float(before @ (h * fw)) / mu_down) if abs(mu_down) > 1e-12 else 0.0
    nu_down = float(last @ (h * last))
    nu = max(0.0, -float(last @ (h * fw)) / nu_down + mu * lam / max(1e-9, 1 - lam)) if nu_down > 1e-12 else 0.0
    b0 = 1 / (1 + mu + nu)
    return {m: b0 * y[m] + nu * b0 * older[-1][m] + mu * b0 * older[-2][m] for m in x}
