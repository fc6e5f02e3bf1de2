"""OD estimation from counts, vehicles, queue simulation and map matching."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .reports import hhmmss, point_to_segment


def link_totals(pairs: DataFrame) -> DataFrame:
    """link_id, v: volumes of pairs, or of routes by their ``share``, on links."""
    q = F.col("volume") * F.col("share") if "share" in pairs.columns else F.col("volume")
    return pairs.filter("links IS NOT NULL").select(F.explode("links").alias("link_id"), q.alias("q")).groupBy("link_id").agg(F.sum("q").alias("v"))


def _sq(c: Column) -> Column:
    return c * c


def objective(pairs: DataFrame, counts: DataFrame, w_od: float = 1.0, w_link: float = 1.0, w_vmt: float = 0.0, vmt: float = 0.0) -> DataFrame:
    """(od_term, link_term, total), and vmt_term with a weight for it.

    pairs: volume, target, links; for vehicle miles also miles, for routes also share and route (a pair's
    volume and target count once, with route 0). counts: link_id, obs (used above 1).
    """
    once = pairs.filter("route = 0") if "route" in pairs.columns else pairs
    od = once.agg(F.sum(_sq(F.col("volume") - F.col("target"))).alias("od_term"))
    used = F.broadcast(counts.filter("obs > 1"))  # at most a row a link
    ln = used.join(link_totals(pairs), "link_id", "left").agg(F.sum(_sq(F.coalesce("v", F.lit(0.0)) - F.col("obs"))).alias("link_term"))
    both = od.crossJoin(ln)
    if not w_vmt:
        return both.withColumn("total", w_od * F.col("od_term") + w_link * F.col("link_term"))
    both = both.crossJoin(_miles(pairs).select(_sq(F.col("vmt") - vmt).alias("vmt_term")))
    return both.withColumn("total", w_od * F.col("od_term") + w_link * F.col("link_term") + w_vmt * F.col("vmt_term"))


def _miles(pairs: DataFrame) -> DataFrame:
    share = F.col("share") if "share" in pairs.columns else F.lit(1.0)
    return pairs.filter("links IS NOT NULL").agg(F.coalesce(F.sum(F.col("volume") * share * F.col("miles")), F.lit(0.0)).alias("vmt"))


def gradient(pairs: DataFrame, counts: DataFrame, w_od: float = 1.0, w_link: float = 1.0, w_vmt: float = 0.0, vmt: float = 0.0) -> DataFrame:
    """mode, o, d, gradient of the objective by the pair's volume; routes count by their share."""
    used = F.broadcast(counts.filter("obs > 1"))
    off = used.join(link_totals(pairs), "link_id", "left").select("link_id", (F.coalesce("v", F.lit(0.0)) - F.col("obs")).alias("off"))
    share = F.col("share") if "share" in pairs.columns else F.lit(1.0)
    steps = pairs.filter("links IS NOT NULL").select("mode", "o", "d", share.alias("s"), F.explode("links").alias("link_id")).join(F.broadcast(off), "link_id")
    by = steps.groupBy("mode", "o", "d").agg(F.sum(F.col("off") * F.col("s")).alias("off"))
    once = pairs.filter("route = 0") if "route" in pairs.columns else pairs
    g = 2 * w_od * (F.col("volume") - F.col("target")) + 2 * w_link * F.coalesce("off", F.lit(0.0))
    out = once.join(by, ["mode", "o", "d"], "left")
    if w_vmt:
        miles = pairs.filter("links IS NOT NULL").groupBy("mode", "o", "d").agg(F.sum(share * F.col("miles")).alias("_m"))
        out = out.join(miles, ["mode", "o", "d"], "left").crossJoin(F.broadcast(_miles(pairs)))  # one row
        g = g + 2 * w_vmt * (F.col("vmt") - vmt) * F.coalesce("_m", F.lit(0.0))
    return out.select("mode", "o", "d", g.alias("gradient"))


def estimate(pairs: DataFrame, counts: DataFrame, iterations: int = 20, w_od: float = 1.0, w_link: float = 1.0, w_vmt: float = 0.0, vmt: float = 0.0) -> DataFrame:
    """pairs with volumes moved towards the counts: projected gradient steps with Armijo halving, from half to
    1.5 times of seed and target (cells of up to 0.001 stay). Ends at a small gradient, without a step that helps,
    or when from the fifth step on the objective is worse than the best. Each trial is one job, each accepted
    step a written table; only sums come to the driver."""
    weights = (w_od, w_link, w_vmt, vmt)
    fixed = F.greatest("volume", "target") <= 0.001
    low, high = F.when(fixed, F.col("volume")).otherwise(0.5 * F.least("volume", "target")), F.when(fixed, F.col("volume")).otherwise(1.5 * F.greatest("volume", "target"))
    now = written(pairs.withColumns({"low": low, "high": high}))
    value = best = objective(now, counts, *weights).first()["total"]
    for k in range(iterations):
        g = written(now.join(gradient(now, counts, *weights), ["mode", "o", "d"]))
        size = g.filter("route = 0" if "route" in pairs.columns else "true").agg(F.sum(F.col("gradient") * F.col("gradient"))).first()[0] or 0.0
        step, moved = 0.2, False
        while size >= 1 and step > 1e-8:
            trial = g.withColumn("volume", F.greatest("low", F.least("high", F.col("volume") - step * F.col("gradient")))).drop("gradient")
            got = objective(trial, counts, *weights).first()["total"]
            if got <= value - 0.05 * step * size or (got < value and step < 1e-3):
                now, value, moved = written(trial), got, True
                break
            step /= 2
        best = min(best, value)
        if not moved or (k >= 5 and (value > best + 1 or value > 1.1 * best)):
            break
    return now.drop("low", "high")


def vehicles(pairs: DataFrame, start: float = 420.0, minutes: float = 60.0) -> DataFrame:
    """One row a vehicle: whole trips plus one more where a hash falls below the rest; even spacing over the period."""
    extra = F.pmod(F.xxhash64("mode", "o", "d"), F.lit(1_000_000)) / 1e6 < F.col("volume") - F.floor("volume")
    n = F.floor("volume") + extra.cast("long")
    rows = pairs.filter("links IS NOT NULL").withColumn("n", n).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    leave = F.lit(start) + (F.col("i") - 1) * minutes / F.col("n")
    return rows.select("mode", "o", "d", "i", leave.alias("departure_minute"), hhmmss(leave).alias("departure"), "links")


def _run(links: pd.DataFrame, agents: pd.DataFrame, hours: float, tick: float, trajectory: bool = False) -> pd.DataFrame:
    """Agents move link by link, first in first out; a full next link or an exhausted outflow holds them back."""
    ids = {int(k): i for i, k in enumerate(links.link_id)}
    ride = np.maximum(1, (links.fftt.to_numpy() * 60 / tick).astype(int))
    room = np.maximum(1.0, links.capacity.to_numpy() * links.lanes.to_numpy() / 3600 * 60)
    flow, credit = links.capacity.to_numpy() * links.lanes.to_numpy() / 3600 * tick, np.zeros(len(links))
    agents = agents.sort_values(["departure_minute", "agent_id"]).reset_index(drop=True)
    path = [[ids[k] for k in row] for row in agents.links]
    due = ((agents.departure_minute - agents.departure_minute.min()) * 60 / tick).astype(int).to_numpy() if len(agents) else np.zeros(0, int)
    queue = [deque() for _ in range(len(links))]
    at, ready, done, released = np.zeros(len(agents), int), np.zeros(len(agents), int), np.full(len(agents), -1), 0
    entered = [[] for _ in range(len(agents))]
    left, total = sum(1 for p in path if p), int(hours * 3600 / tick)
    for t in range(total):
        if not left and released == len(agents):
            break
        while released < len(agents) and due[released] <= t:
            if path[released]:
                first = path[released][0]
                queue[first].append(released)
                entered[released].append(t)
                ready[released] = t + ride[first]
            released += 1
        credit = np.minimum(credit + flow, np.maximum(1.0, flow))
        for k in range(len(links)):
            while queue[k] and ready[queue[k][0]] <= t and credit[k] >= 1:
                a = queue[k][0]
                if at[a] + 1 == len(path[a]):
                    done[a] = t
                    left -= 1
                else:
                    to = path[a][at[a] + 1]
                    if len(queue[to]) >= room[to] * max(1, ride[to]):
                        break
                    queue[to].append(a)
                    entered[a].append(t)
                    ready[a] = t + ride[to]
                    at[a] += 1
                queue[k].popleft()
                credit[k] -= 1
    start = agents.departure_minute.min() if len(agents) else 0.0
    if trajectory:
        rows = [(i, n + 1, links.link_id[path[k][n]], start + t * tick / 60, (start + (entered[k][n + 1] if n + 1 < len(entered[k]) else done[k]) * tick / 60) if n + 1 < len(entered[k]) or done[k] >= 0 else None) for k, i in enumerate(agents.agent_id) for n, t in enumerate(entered[k])]
        return pd.DataFrame(rows, columns=["agent_id", "place", "link_id", "enter_minute", "leave_minute"])
    return pd.DataFrame({"agent_id": agents.agent_id, "departure_minute": agents.departure_minute, "arrival_minute": np.where(done >= 0, start + done * tick / 60, np.nan), "completed": done >= 0})


def independent_parts(agents: DataFrame) -> DataFrame:
    """agents with ``part``: those whose links no other part's agents use, directly or over others.

    What comes to the driver is one row a pair of links that follow each other, so it grows with the
    network and not with the agents.
    """
    ahead = F.transform(F.sequence(F.lit(0), F.size("links") - 1), lambda i: F.struct(F.get("links", i).alias("a"), F.coalesce(F.get("links", i + 1), F.get("links", i)).alias("b")))
    turns = agents.filter(F.size("links") > 0).select(F.explode(ahead).alias("t")).select("t.a", "t.b").distinct().toPandas()
    root = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in turns.itertuples(index=False):
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    table = agents.sparkSession.createDataFrame([(k, find(k)) for k in root], "first_link long, part long")
    return agents.withColumn("first_link", F.get("links", F.lit(0))).join(F.broadcast(table), "first_link", "left").drop("first_link").withColumn("part", F.coalesce("part", F.lit(-1)))


def simulate(links: DataFrame, agents: DataFrame, hours: float = 2.0, tick: float = 6.0, part: str | None = None, trajectory: bool = False) -> DataFrame:
    """agent_id, departure and arrival, completed. agents: agent_id, departure_minute, links.

    Agents that share no road run apart, each such part in one task: those of ``independent_parts``, or by
    a column ``part`` of agents. It ends with the period, or when all have arrived. With ``trajectory``:
    agent_id, place, link_id, enter_minute, leave_minute of every link that an agent entered.
    """
    if part is None:
        agents, part = independent_parts(agents.drop("part")), "part"
    held = links.sparkSession.sparkContext.broadcast(links.select("link_id", "fftt", "capacity", "lanes").orderBy("link_id").toPandas())  # the network

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _run(held.value, rows, hours, tick, trajectory)

    schema = "agent_id long, place int, link_id long, enter_minute double, leave_minute double" if trajectory else "agent_id long, departure_minute double, arrival_minute double, completed boolean"
    return agents.groupBy(part).applyInPandas(run, schema)


def nearest(points: DataFrame, shapes: DataFrame, name: str, cell: float, *keys: str) -> DataFrame:
    """keys, ``name``, distance: the shape nearest to each point, the least name where several are.

    points: keys, x, y; shapes: name, x1, y1, x2, y2. Points meet shapes in equal grid cells, so it is an
    equi-join; what is further than a cell is sought again with cells of twice the size, until all points
    have theirs. An empty table of shapes gives no rows.
    """
    out, left = None, points.select(*keys, "x", "y")
    if shapes.isEmpty():
        return points.limit(0).select(*keys, F.lit(0).cast("long").alias(name), F.lit(0.0).alias("distance"))
    for _ in range(64):
        c = lambda v, w=cell: F.floor(v / w)
        span = lambda a, b: F.sequence(c(F.least(a, b)) - 1, c(F.greatest(a, b)) + 1)
        boxes = shapes.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))
        near = left.withColumns({"_cx": c(F.col("x")), "_cy": c(F.col("y"))}).join(boxes, ["_cx", "_cy"])
        near = near.withColumn("distance", F.round(point_to_segment(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 9))
        found = near.groupBy(*keys).agg(F.min(F.struct("distance", name)).alias("b")).select(*keys, F.col(f"b.{name}").alias(name), F.col("b.distance").alias("distance")).filter(F.col("distance") <= cell)
        found = written(found)
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(*keys), list(keys), "left_anti")
        if left.isEmpty():
            return out
        left, cell = written(left), cell * 2
    raise RuntimeError("points too far from all shapes")


def cell_size(shapes: DataFrame) -> float:
    """The mean extent of shapes, for cells of which a shape meets a few."""
    r = shapes.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))))).first()[0]
    return float(r) if r else 1.0


def match_points(points: DataFrame, links: DataFrame, cell: float | None = None) -> DataFrame:
    """agent_id, trace_no, link_id, distance: the nearest link of every position.

    points: agent_id, trace_no, x, y; links: link_id, x1, y1, x2, y2.
    """
    return nearest(points, links, "link_id", cell or cell_size(links), "agent_id", "trace_no")


def dwells(points: DataFrame, cell: float, minutes: float = 120.0) -> DataFrame:
    """agent_id, cx, cy, first_minute, last_minute, dwells: how long an agent is seen in a cell. points with ``minute``."""
    at = points.groupBy("agent_id", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"))
    return at.withColumn("dwells", F.col("last_minute") - F.col("first_minute") > minutes)


def trace_ends(points: DataFrame, zones: DataFrame, cell: float | None = None) -> DataFrame:
    """agent_id, o, d: the zones nearest to the mean of the first and of the last three points."""
    first, last = Window.partitionBy("agent_id").orderBy("trace_no"), Window.partitionBy("agent_id").orderBy(F.desc("trace_no"))
    p = points.withColumns({"a": F.row_number().over(first), "b": F.row_number().over(last)})
    ends = None
    for k, name in (("a", "o"), ("b", "d")):
        mean = p.filter(F.col(k) <= 3).groupBy("agent_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("end", F.lit(name))
        ends = mean if ends is None else ends.unionByName(mean)
    z = zones.select("zone_id", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2"))
    near = nearest(ends, z, "zone_id", cell or 1.0, "agent_id", "end")
    return near.groupBy("agent_id").agg(F.max(F.when(F.col("end") == "o", F.col("zone_id"))).alias("o"), F.max(F.when(F.col("end") == "d", F.col("zone_id"))).alias("d"))


def trace_routes(ends: DataFrame, links: DataFrame, cost: str = "fftt") -> DataFrame:
    """agent_id, o, d, cost, links: the free-flow path between the ends of each trace; each pair is searched once."""
    from .paths import load_pairs

    pairs = ends.select("o", "d").distinct().select(F.lit("trace").alias("mode"), "o", "d", F.lit(1.0).alias("volume"))
    found = load_pairs(links, pairs, cost, modes=False).select("o", "d", "cost", "links")
    return ends.join(found, ["o", "d"], "left").select("agent_id", "o", "d", "cost", "links")
