"""Reports, quality checks and network edits as DataFrame operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vdf

K = vdf.OnColumns


def with_load(links: DataFrame, hours: float = 1.0) -> DataFrame:
    """Adds D (hourly lane demand) and doc (over capacity)."""
    d, x = vdf.demand_over_capacity(K, F.col("volume"), F.col("lanes"), hours, F.col("plf"), F.col("capacity"))
    return links.withColumns({"D": d, "doc": x})


def own_parameters(links: DataFrame) -> dict[str, Column]:
    """The links' delay parameters by name, as far as they have them."""
    return {n: F.col(n) for n in vdf.DEFAULTS if n in links.columns}


def with_time(links: DataFrame, hours: float = 1.0, **options) -> DataFrame:
    c = F.col
    options = {**own_parameters(links), **options}
    return with_load(links, hours).withColumn("travel_time", vdf.travel_time(K, c("vdf_type"), c("fftt"), c("doc"), c("alpha"), c("beta"), c("length"), c("free_speed"), hours=hours, **options))


def link_performance(links: DataFrame, hours: float = 1.0, occupancy: float = 1.0, modes: DataFrame | None = None, **options) -> DataFrame:
    """Times, speeds, vehicle and person miles and hours. With ``modes`` (mode, occ) and class volumes
    (mod_vol_*) persons are counted by class; else by one occupancy."""
    p = with_time(links, hours, **options)
    if modes is not None and (held := [c for c in links.columns if c.startswith("mod_vol_")]):
        occ = {m["mode"]: m["occ"] for m in modes.select("mode", "occ").collect()}  # a handful of classes
        persons = sum((F.col(c) * float(occ.get(c[8:], 1.0)) for c in held), F.lit(0.0))
        p = p.withColumn("_persons", persons)
        return p.withColumns({"speed": F.col("length") / F.greatest(F.lit(1e-9), F.col("travel_time")) * 60, "VMT": F.col("volume") * F.col("length"), "VHT": F.col("volume") * F.col("travel_time") / 60, "PMT": F.col("_persons") * F.col("length"), "PHT": F.col("_persons") * F.col("travel_time") / 60}).drop("_persons")
    return p.withColumns({"speed": F.col("length") / F.greatest(F.lit(1e-9), F.col("travel_time")) * 60, "VMT": F.col("volume") * F.col("length"), "VHT": F.col("volume") * F.col("travel_time") / 60, "PMT": F.col("volume") * F.col("length") * occupancy, "PHT": F.col("volume") * F.col("travel_time") / 60 * occupancy})


def queue_report(links: DataFrame, start: float = 7.0, end: float = 8.0) -> DataFrame:
    """Queue-based measures of every link by its own parameters: congested hours P with its times, lowest speed,
    discharge rate and shape."""
    c, h = F.col, end - start
    own = own_parameters(links)
    cp, cd, n, s = (own.get(k, F.lit(vdf.DEFAULTS[k])) for k in ("cp", "cd", "n", "s"))
    df = with_load(links, h).withColumn("cutoff", own.get("cutoff", 0.75 * c("free_speed")))
    ref, queue, p, period = vdf.queue_speeds(K, c("doc"), c("free_speed"), c("cutoff"), c("alpha"), c("beta"), cd, n, h)
    df = df.withColumns({"ref_speed": ref, "queue_speed": queue, "P": p, "period_speed": period})
    df = df.withColumns({"vt2": c("cutoff") / F.greatest(F.lit(0.001), cp * F.pow(c("P"), s) + 1), "t0": F.lit((start + end) / 2) - 0.5 * c("P"), "t3": F.lit((start + end) / 2) + 0.5 * c("P"), "mu": F.least("capacity", c("D") / F.greatest(F.lit(0.01), c("P"))), "rtt": c("length") / F.greatest(F.lit(0.01), c("ref_speed"))})
    return df.withColumns({"gamma": F.when(c("P") > 0, (c("length") / c("vt2") - c("rtt")) * 64 * c("mu") / F.pow(F.nullif("P", F.lit(0.0)), F.lit(4.0))).otherwise(0.0), "qvdf_minutes": c("length") / F.greatest(F.lit(0.1), c("period_speed")) * 60})


def speed_profile(links: DataFrame, start: float = 7.0, end: float = 8.0) -> DataFrame:
    """link_id, minute, speed in steps of five minutes, both ends included."""
    c = F.col
    df = queue_report(links, start, end).withColumn("minute", F.explode(F.sequence(F.lit(int(start * 60)), F.lit(int(end * 60)), F.lit(5)))).withColumn("t", c("minute") / 60)
    slow = F.greatest("ref_speed", "queue_speed")
    wait = 0.25 * c("gamma") * (c("t") - c("t0")) * (c("t") - c("t0")) * (c("t") - c("t3")) * (c("t") - c("t3")) / F.greatest(F.lit(0.001), c("mu"))
    up, down = (c("t") - start) / F.greatest(F.lit(0.001), c("t0") - start), (c("t") - c("t3")) / F.greatest(F.lit(0.001), end - c("t3"))
    speed = F.when((c("t0") <= c("t")) & (c("t") <= c("t3")), c("length") / (wait + c("rtt"))).when(c("t") < c("t0"), (1 - up) * c("free_speed") + up * slow).otherwise((1 - down) * slow + down * c("free_speed"))
    return df.select("link_id", "minute", "free_speed", speed.alias("speed"))


def severe_hours(links: DataFrame, start: float = 7.0, end: float = 8.0) -> DataFrame:
    slow = F.sum(F.when(F.col("speed") < 0.5 * F.col("free_speed"), 5).otherwise(0)) / 60
    return speed_profile(links, start, end).groupBy("link_id").agg(slow.alias("severe_hours"))


def allowed(use: Column, mode: Column) -> Column:
    return (F.coalesce(use, F.lit("")) == "") | (use == "all") | F.contains(use, mode)


def mode_costs(links: DataFrame, modes: DataFrame) -> DataFrame:
    """link x class: minutes of toll and operating cost, and whether the class may use the link."""
    c = F.col
    both = links.crossJoin(F.broadcast(modes))  # a handful of classes
    return both.select("link_id", "mode", vdf.generalized_minutes(c("toll"), c("length"), c("operating_cost"), c("vot")).alias("fixed_minutes"), allowed(c("allowed_use"), c("mode")).alias("allowed"))


def haversine_miles(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 3958.8 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_metres(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return haversine_miles(x1, y1, x2, y2) / 3958.8 * 6_371_000


def hhmmss(minutes: Column) -> Column:
    total = F.floor(minutes * 60).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60)


def point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / long)))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def point_to_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance to the segment where the point projects onto it, else null."""
    dx, dy = bx - ax, by - ay
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.when((t >= 0) & (t <= 1), point_to_segment(px, py, ax, ay, bx, by))


def wkt_line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.format_string("LINESTRING (%.6f %.6f, %.6f %.6f)", x1, y1, x2, y2)


def wkt_path(points: Column) -> Column:
    """points: array of (x, y)."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), ", "), F.lit(")"))


def map_url(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A directions link between two places, latitude first."""
    return F.format_string("https://www.google.com/maps/dir/%.6f,%.6f/%.6f,%.6f", y1, x1, y2, x2)


def joined_ids(ids: Column) -> Column:
    """Ids joined by ``;``, with one at the end."""
    return F.concat(F.array_join(F.transform(ids, lambda x: x.cast("string")), ";"), F.when(F.size(ids) > 0, ";").otherwise(""))


def bound_plf(plf: Column, hours: float) -> Column:
    """Into (0, 1], and not below one hour of the period; 0.25 where it isn't positive."""
    return F.when(plf <= 0, F.lit(0.25)).otherwise(F.greatest(F.least(plf, F.lit(1.0)), F.lit(1.0 / hours)))


def validate(links: DataFrame, nodes: DataFrame, demand: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """(severity, file, code, item): one row a finding."""
    say = lambda df, severity, file, code, item: df.select(F.lit(severity).alias("severity"), F.lit(file).alias("file"), F.lit(code).alias("code"), item.cast("string").alias("item"))
    known = nodes.select(F.col("node_id").alias("_node"))
    parts = [
        say(nodes.groupBy("node_id").count().filter("count > 1"), "ERROR", "node", "duplicate_node", F.col("node_id")),
        say(links.groupBy("link_id").count().filter("count > 1"), "ERROR", "link", "duplicate_link", F.col("link_id")),
        say(links.join(known, F.col("from_node_id") == F.col("_node"), "left_anti"), "ERROR", "link", "unknown_from", F.col("link_id")),
        say(links.join(known, F.col("to_node_id") == F.col("_node"), "left_anti"), "ERROR", "link", "unknown_to", F.col("link_id")),
        say(links.filter("lanes <= 0 OR capacity <= 0 OR free_speed <= 0"), "ERROR", "link", "not_positive", F.col("link_id")),
        say(demand.filter("volume < 0"), "ERROR", "demand", "negative_volume", F.concat_ws("-", "o", "d")),
        say(demand.join(known, F.col("o") == F.col("_node"), "left_anti"), "WARNING", "demand", "unknown_origin", F.concat_ws("-", "o", "d")),
        say(demand.join(known, F.col("d") == F.col("_node"), "left_anti"), "WARNING", "demand", "unknown_destination", F.concat_ws("-", "o", "d")),
    ]
    if tokens is not None:
        use = links.filter("coalesce(allowed_use, '') NOT IN ('', 'all', 'closed')").select("link_id", F.explode(F.split("allowed_use", "[;,]")).alias("token"))
        parts.append(say(use.filter(~F.trim("token").isin(*tokens)), "WARNING", "link", "unknown_mode", F.concat_ws(":", "link_id", "token")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Defaults of link attributes.
LINK_DEFAULTS = {"link_type": 1, "vdf_type": 0, "alpha": 0.15, "linear": 0.0, "beta": 4.0, "green": 0.45, "plf": 1.0, "cp": 0.28125, "cd": 1.0, "n": 1.0, "s": 4.0, "no_uturn": 0, "toll": 0.0, "ref_volume": 0.0, "allowed_use": ""}


def fill_defaults(links: DataFrame) -> DataFrame:
    """Missing or blank attributes get the engine's defaults; links sorted by (from, to)."""
    out = links.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(dict(links.dtypes)[c])) for c, v in LINK_DEFAULTS.items() if c in links.columns})
    if "cutoff_speed" not in out.columns:
        out = out.withColumn("cutoff_speed", 0.75 * F.col("free_speed"))
    return out.orderBy("from_node_id", "to_node_id")


def use_classes(links: DataFrame, modes: DataFrame) -> DataFrame:
    """(class, links): all, closed, only:m, no:m or custom."""
    n = modes.count()
    can = mode_costs(links, modes).groupBy("link_id").agg(F.sum(F.col("allowed").cast("int")).alias("k"), F.min(F.when(F.col("allowed"), F.col("mode"))).alias("one"), F.min(F.when(~F.col("allowed"), F.col("mode"))).alias("missing"))
    both = links.select("link_id", "allowed_use").join(can, "link_id")
    name = F.when(F.coalesce("allowed_use", F.lit("")).isin("", "all"), "all").when(F.col("allowed_use") == "closed", "closed").when(F.col("k") == n, "all").when(F.col("k") == 1, F.concat(F.lit("only:"), "one")).when(F.col("k") == n - 1, F.concat(F.lit("no:"), "missing")).otherwise("custom")
    return both.groupBy(name.alias("class")).agg(F.count("*").alias("links"))


def fit(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """n, r2 (Pearson), rmse, rmse_percent (of mean b), sums of a and b."""
    err = F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.corr(a, b) * F.corr(a, b)).alias("r2"), F.sqrt(err).alias("rmse"), (F.sqrt(err) / F.avg(b) * 100).alias("rmse_percent"), F.sum(a).alias("sum_a"), F.sum(b).alias("sum_b"))


# Volume groups (from, to) and the error that a group may have, as a share of its mean.
VOLUME_GROUPS = ((0, 2500, 1.00), (2500, 5000, 0.55), (5000, 10000, 0.45), (10000, 25000, 0.30), (25000, 50000, 0.25), (50000, 75000, 0.19), (75000, None, 0.19))


def volume_group(v: Column, groups: tuple = VOLUME_GROUPS) -> Column:
    """The least volume of the group that v is in; those below all count with the last."""
    out = F.lit(groups[-1][0])
    for lo, hi, _ in reversed(groups):
        if hi is not None:
            out = F.when((v >= lo) & (v < hi), F.lit(lo)).otherwise(out)
    return out


def fit_by_group(df: DataFrame, volume: str, ref: str, groups: tuple = VOLUME_GROUPS) -> DataFrame:
    """Per volume group of ``ref``: links, error as a share of the mean, its limit, ratio of the sums, and whether it holds."""
    limit = F.lit(groups[-1][2])
    for lo, _, most in reversed(groups):
        limit = F.when(F.col("g") == lo, F.lit(most)).otherwise(limit)
    by = fit(df.withColumn("g", volume_group(F.col(ref), groups)), volume, ref, "g")
    return by.select("g", "n", (F.col("rmse_percent") / 100).alias("error"), limit.alias("limit"), (F.col("sum_a") / F.col("sum_b")).alias("ratio"), (F.col("rmse_percent") / 100 <= limit).alias("holds"))


def grid_zones(zones: DataFrame, production: DataFrame, target: int) -> DataFrame:
    """zone_id -> rep_id: cells between sqrt(target) quantiles of x and y; a cell's zone of most trips stands for it."""
    g = max(1, round(math.sqrt(target)))
    n = zones.count()
    cell = {}
    for axis in "xy":
        w = Window.orderBy(axis, "zone_id")  # zones, not trips
        values = zones.select(axis, (F.row_number().over(w) - 1).alias("i"))
        at = [min(n - 1, n * i // g) for i in range(1, g)]
        cuts = [r[0] for r in values.filter(F.col("i").isin(at)).orderBy("i").select(axis).collect()] if at else []
        cell[axis] = sum((F.when(F.col(axis) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    df = zones.withColumns({"cx": cell["x"], "cy": cell["y"]}).join(production, "zone_id", "left").withColumn("trips", F.coalesce("trips", F.lit(0.0)))
    rep = df.groupBy("cx", "cy").agg(F.max_by("zone_id", F.struct("trips", -F.col("zone_id"))).alias("rep_id"))
    return df.join(F.broadcast(rep), ["cx", "cy"]).select("zone_id", "rep_id")


def regroup_demand(demand: DataFrame, mapping: DataFrame) -> DataFrame:
    """Trips between representatives; those within one are dropped. mapping: a row a zone."""
    m = F.broadcast(mapping)
    to = demand.join(m.select(F.col("zone_id").alias("o"), F.col("rep_id").alias("ro")), "o").join(m.select(F.col("zone_id").alias("d"), F.col("rep_id").alias("rd")), "d")
    return to.filter("ro <> rd").groupBy("mode", F.col("ro").alias("o"), F.col("rd").alias("d")).agg(F.sum("volume").alias("volume"))


def turn_bans(links: DataFrame, movements: DataFrame | None = None, uturns: bool = False) -> DataFrame:
    """(ib_link_id, ob_link_id) that may not follow each other: penalty of 10 or more, and U-turns if asked."""
    a = links.select(F.col("link_id").alias("ib_link_id"), F.col("from_node_id").alias("a0"), F.col("to_node_id").alias("at"))
    b = links.select(F.col("link_id").alias("ob_link_id"), F.col("from_node_id").alias("at"), F.col("to_node_id").alias("b1"))
    turns = a.join(b, "at")
    out = None
    if movements is not None:
        out = turns.join(movements.filter("penalty >= 10").select("ib_link_id", "ob_link_id"), ["ib_link_id", "ob_link_id"]).select("ib_link_id", "ob_link_id")
    if uturns:
        back = turns.filter("a0 = b1").select("ib_link_id", "ob_link_id")
        out = back if out is None else out.unionByName(back).distinct()
    return out


def renumber(nodes: DataFrame) -> DataFrame:
    """node_id -> new_id: zones first, each part in order of id."""
    w = Window.orderBy(F.when(F.coalesce("zone_id", F.lit(0)) > 0, 0).otherwise(1), "node_id")
    return nodes.select("node_id", F.row_number().over(w).cast("long").alias("new_id"))


def system_performance(pairs: DataFrame, lengths: DataFrame, modes: DataFrame) -> DataFrame:
    """Per class: trips, person miles and hours, mean distance and time. pairs: as ``load`` returns them."""
    d = pair_lengths(pairs, lengths)
    return d.join(F.broadcast(modes.select("mode", "occ")), "mode").groupBy("mode").agg(
        F.sum("volume").alias("volume"), F.sum(F.col("volume") * F.col("miles") * F.col("occ")).alias("pmt"), F.sum(F.col("volume") * F.col("cost") * F.col("occ") / 60).alias("pht"),
        (F.sum(F.col("volume") * F.col("miles")) / F.sum("volume")).alias("mean_miles"), (F.sum(F.col("volume") * F.col("cost")) / F.sum("volume")).alias("mean_minutes"),
    )


def delay_performance(pairs: DataFrame, lengths: DataFrame, free: DataFrame) -> DataFrame:
    """Per class: hours, hours at free flow, delay, travel time index, mean speed and free speed.

    free: mode, o, d, free_minutes of the same pairs.
    """
    d = pair_lengths(pairs, lengths).join(free, ["mode", "o", "d"])
    v, c = F.col("volume"), F.col
    a = d.groupBy("mode").agg(F.sum(v * c("cost") / 60).alias("hours"), F.sum(v * c("free_minutes") / 60).alias("free_hours"), F.sum(v * c("miles")).alias("miles"))
    return a.select("mode", "hours", "free_hours", (c("hours") - c("free_hours")).alias("delay"), (c("hours") / F.nullif("free_hours", F.lit(0.0))).alias("tti"), (c("miles") / F.nullif("hours", F.lit(0.0))).alias("speed"), (c("miles") / F.nullif("free_hours", F.lit(0.0))).alias("free_speed"))


def totals(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: pairs and trips with a path, mean miles and minutes of pairs and of trips."""
    d, v = pair_lengths(pairs, lengths), F.col("volume")
    return d.agg(F.count("*").alias("pairs"), F.sum(v).alias("trips"), F.avg("miles").alias("pair_miles"), F.avg("cost").alias("pair_minutes"), (F.sum(v * F.col("miles")) / F.sum(v)).alias("trip_miles"), (F.sum(v * F.col("cost")) / F.sum(v)).alias("trip_minutes"))


def pair_lengths(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Reachable pairs with the miles of their path. lengths: link_id, length."""
    if "miles" in pairs.columns:
        return pairs.filter("links IS NOT NULL")
    steps = pairs.filter("links IS NOT NULL").select("mode", "o", "d", F.explode("links").alias("link_id"))
    miles = steps.join(F.broadcast(lengths.select("link_id", "length")), "link_id").groupBy("mode", "o", "d").agg(F.sum("length").alias("miles"))
    return pairs.filter("links IS NOT NULL").join(miles, ["mode", "o", "d"], "left").withColumn("miles", F.coalesce("miles", F.lit(0.0)))


def accessibility(pairs: DataFrame, zones: DataFrame, end: str, lengths: DataFrame) -> DataFrame:
    """Per zone as origin (end = 'o') or destination ('d'): trips, partners, mean miles and minutes; zeros where none."""
    other = "d" if end == "o" else "o"
    a = pair_lengths(pairs, lengths).groupBy(F.col(end).alias("zone_id")).agg(F.sum("volume").alias("volume"), F.countDistinct(other).alias("partners"), (F.sum(F.col("volume") * F.col("miles")) / F.sum("volume")).alias("mean_miles"), (F.sum(F.col("volume") * F.col("cost")) / F.sum("volume")).alias("mean_minutes"))
    return zones.select("zone_id").join(a, "zone_id", "left").fillna(0)
