"""All registered queries of the traffic operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vdf
from .operators import assign as solver
from .operators import checks, compare, paths, reports, staging, workflow
from .sources import gmns
from .plans.scenario import derived, with_ctes

QUERIES: dict = {}
ORACLES: dict = {}
K = vdf.OnColumns


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def rounded(df: DataFrame, *keys: str, digits: int = 6, **columns) -> DataFrame:
    return df.select(*keys, *[F.round(c if hasattr(c, "alias") else F.col(c), digits).alias(n) for n, c in columns.items()])


def links(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "link")


LOADED = with_ctes("link") + """, v AS (SELECT *, volume / greatest(0.01e0, lanes) / greatest(0.0001e0, plf) AS D,
  volume / greatest(0.01e0, lanes) / greatest(0.0001e0, plf) / greatest(0.1e0, capacity) AS x, 0.75e0 * free_speed AS vc FROM link)"""
BPR = "fftt * (1 + alpha * pow(x, beta))"
REF = "CASE WHEN x < 1 THEN (1 - x) * free_speed + x * vc ELSE vc END"
PERIOD = f"CASE WHEN x > 1 THEN ({REF}) / (1 + alpha * pow(x, beta)) ELSE x * (({REF}) / (1 + alpha * pow(x, beta))) + (1 - x) * (({REF}) + free_speed) / 2 END"
FORMULAS = {
    "bpr": (lambda k, c: vdf.bpr(k, c.fftt, c.doc, c.alpha, c.beta), BPR),
    "modified_bpr": (lambda k, c: vdf.bpr(k, c.fftt, c.doc, c.alpha, c.beta, 0.2), "fftt * (1 + 0.2e0 * x + alpha * pow(x, beta))"),
    "conic": (lambda k, c: vdf.conic(k, c.fftt, c.doc, c.alpha, c.beta), "fftt * (2 + sqrt(alpha * alpha * (1 - x) * (1 - x) + beta * beta) - alpha * (1 - x) - beta)"),
    "qvdf": (lambda k, c: vdf.qvdf(k, c.doc, c.length, c.free_speed, 0.75 * c.free_speed, c.alpha, c.beta, 1.0, 1.0, 1.0), f"length / greatest(0.1e0, {PERIOD}) * 60"),
    "bpr2": (lambda k, c: vdf.bpr2(k, c.fftt, c.doc, c.alpha, c.beta), "fftt * (1 + alpha * pow(x, CASE WHEN x > 1 THEN 2 * beta ELSE beta END))"),
    "inrets": (lambda k, c: vdf.inrets(k, c.fftt, c.doc, c.alpha), "CASE WHEN x <= 1 THEN fftt * (1.1e0 - alpha * x) / greatest(0.05e0, 1.1e0 - x) ELSE fftt * ((1.1e0 - alpha) / 0.1e0) * x * x END"),
    "akcelik": (lambda k, c: vdf.akcelik(k, c.fftt, c.doc, c.alpha, c.beta), "fftt + alpha * (x - 1 + sqrt((x - 1) * (x - 1) + beta * x))"),
    "signal": (lambda k, c: vdf.signal(k, c.fftt, c.doc, c.alpha, c.beta, F.lit(0.45)), f"{BPR} + 0.5e0 * 60 * 0.3025e0 / greatest(0.05e0, 1 - least(1e0, x) * 0.45e0) / 60"),
    "added_delay": (lambda k, c: k.most(0.0, vdf.bpr(k, c.fftt, c.doc, c.alpha, c.beta) + 1.4 * c.length), f"greatest(0e0, {BPR} + 1.4e0 * length)"),
}


class _Columns:
    def __getattr__(self, name):
        return F.col(name)


for _name, (_f, _sql) in FORMULAS.items():
    register(f"vdf_{_name}", lambda spark, sf, f=_f: rounded(reports.with_load(links(spark, sf)), "link_id", travel_time=f(K, _Columns())), f"{LOADED} SELECT link_id, round({_sql}, 6) AS travel_time FROM v")
_BY_TYPE = f"CASE vdf_type WHEN 0 THEN {BPR} " + " ".join(f"WHEN {i} THEN {FORMULAS[n][1]}" for i, n in enumerate(("conic", "qvdf", "bpr2", "inrets", "akcelik", "signal"), 1)) + " END"
TIMED = LOADED + f", p AS (SELECT *, {_BY_TYPE} AS tt FROM v)"

_PERF = {"D": "D", "doc": "doc", "travel_time": "travel_time", "speed": "speed", "VMT": "VMT", "VHT": "VHT"}
register("link_times_by_type", lambda s, sf: rounded(reports.with_time(links(s, sf)), "link_id", travel_time="travel_time"), f"{TIMED} SELECT link_id, round(tt, 6) AS travel_time FROM p")
register("qvdf_report", lambda s, sf: rounded(reports.queue_report(links(s, sf)), "link_id", D="D", doc="doc", P="P", ref_speed="ref_speed", queue_speed="queue_speed", period_speed="period_speed", vt2="vt2", t0="t0", t3="t3", mu="mu", qvdf_minutes="qvdf_minutes"),
         f"{LOADED} SELECT link_id, round(D, 6) AS D, round(x, 6) AS doc, round(x, 6) AS P, round({REF}, 6) AS ref_speed, round(({REF}) / (1 + alpha * pow(x, beta)), 6) AS queue_speed, round({PERIOD}, 6) AS period_speed, round(vc / greatest(0.001e0, 0.28125e0 * pow(x, 4) + 1), 6) AS vt2, round(7.5e0 - 0.5e0 * x, 6) AS t0, round(7.5e0 + 0.5e0 * x, 6) AS t3, round(least(capacity, D / greatest(0.01e0, x)), 6) AS mu, round(length / greatest(0.1e0, {PERIOD}) * 60, 6) AS qvdf_minutes FROM v")
_PROFILE = LOADED + f""", w AS (SELECT *, {REF} AS ref, ({REF}) / (1 + alpha * pow(x, beta)) AS queue, vc / greatest(0.001e0, 0.28125e0 * pow(x, 4) + 1) AS vt2, 7.5e0 - 0.5e0 * x AS t0, 7.5e0 + 0.5e0 * x AS t3, least(capacity, D / greatest(0.01e0, x)) AS mu FROM v),
g AS (SELECT *, length / greatest(0.01e0, ref) AS rtt FROM w), h AS (SELECT *, (length / vt2 - rtt) * 64 * mu / pow(x, 4) AS gamma, minute, minute / 60 AS t FROM g, (SELECT unnest(range(420, 481, 5)) AS minute) m),
sp AS (SELECT link_id, minute, free_speed, CASE WHEN t0 <= t AND t <= t3 THEN length / (0.25e0 * gamma * (t - t0) * (t - t0) * (t - t3) * (t - t3) / greatest(0.001e0, mu) + rtt)
  WHEN t < t0 THEN (1 - (t - 7) / greatest(0.001e0, t0 - 7)) * free_speed + (t - 7) / greatest(0.001e0, t0 - 7) * greatest(ref, queue)
  ELSE (1 - (t - t3) / greatest(0.001e0, 8 - t3)) * greatest(ref, queue) + (t - t3) / greatest(0.001e0, 8 - t3) * free_speed END AS speed FROM h)"""
register("qvdf_speed_profile", lambda s, sf: rounded(reports.speed_profile(links(s, sf)), "link_id", "minute", digits=5, speed="speed"), f"{_PROFILE} SELECT link_id, CAST(minute AS INT) AS minute, round(speed, 5) AS speed FROM sp")
register("severe_congestion", lambda s, sf: rounded(reports.severe_hours(links(s, sf)), "link_id", severe_hours="severe_hours"), f"{_PROFILE} SELECT link_id, round(sum(CASE WHEN speed < 0.5e0 * free_speed THEN 5 ELSE 0 END) / 60, 6) AS severe_hours FROM sp GROUP BY link_id")
register("generalized_cost", lambda s, sf: rounded(reports.mode_costs(links(s, sf), derived(s, sf, "mode")), "link_id", "mode", fixed_minutes="fixed_minutes"), with_ctes("link", "mode") + " SELECT link_id, mode, round((toll + length * operating_cost) / vot * 60, 6) AS fixed_minutes FROM link, mode")
_CAN = "(allowed_use = '' OR allowed_use = 'all' OR contains(allowed_use, mode))"
register("allowed_use_matrix", lambda s, sf: reports.mode_costs(links(s, sf), derived(s, sf, "mode")).select("link_id", "mode", "allowed"), with_ctes("link", "mode") + f" SELECT link_id, mode, {_CAN} AS allowed FROM link, mode")


def haversine_od(s, sf):
    n = derived(s, sf, "node").select(F.col("node_id").alias("o"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    m = n.toDF("d", "x2", "y2")
    return rounded(n.crossJoin(F.broadcast(m)), "o", "d", miles=reports.haversine_miles(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


register("haversine_od", haversine_od, with_ctes("node") + " SELECT a.node_id AS o, b.node_id AS d, round(3958.8e0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 6) AS miles FROM (SELECT a.node_id, b.node_id, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2) AS h FROM node a, node b) q(an, bn, h) JOIN node a ON a.node_id = an JOIN node b ON b.node_id = bn")
register("departure_clock", lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", reports.hhmmss(F.lit(420) + F.col("o_orderkey") % 1200 / 8).alias("departure")), "SELECT o_orderkey, printf('%02d:%02d:%02d', CAST(t // 3600 AS INT), CAST(t % 3600 // 60 AS INT), CAST(t % 60 AS INT)) AS departure FROM (SELECT o_orderkey, CAST(floor((420 + o_orderkey % 1200 / 8) * 60) AS BIGINT) AS t FROM orders)")

# quality checks: the derived tables with known faults put in
BROKEN_LINK = "broken AS (SELECT * REPLACE (CASE WHEN link_id % 13 = 0 THEN 0 ELSE lanes END AS lanes, CASE WHEN link_id % 17 = 0 THEN 99 ELSE to_node_id END AS to_node_id) FROM link UNION ALL SELECT * FROM link WHERE link_id % 19 = 0)"
BROKEN_OD = "trips AS (SELECT mode, CASE WHEN o = 7 THEN 77 ELSE o END AS o, d, CASE WHEN d = 3 THEN -volume ELSE volume END AS volume FROM demand)"


def broken(s, sf):
    v = links(s, sf)
    bad = v.withColumns({"lanes": F.when(F.col("link_id") % 13 == 0, 0).otherwise(F.col("lanes")), "to_node_id": F.when(F.col("link_id") % 17 == 0, 99).otherwise(F.col("to_node_id"))})
    trips = derived(s, sf, "demand").withColumns({"volume": F.when(F.col("d") == 3, -F.col("volume")).otherwise(F.col("volume")), "o": F.when(F.col("o") == 7, 77).otherwise(F.col("o"))})
    return bad.unionByName(v.filter("link_id % 19 = 0")), trips


def validate_issues(s, sf):
    bad, trips = broken(s, sf)
    return reports.validate(bad, derived(s, sf, "node"), trips, ["AUTOMOBILE", "BUILDING"])


register("validate_issues", validate_issues, with_ctes("link", "demand") + f", {BROKEN_LINK}, {BROKEN_OD}" + """
SELECT 'ERROR' AS severity, 'link' AS file, 'duplicate_link' AS code, CAST(link_id AS VARCHAR) AS item FROM broken GROUP BY link_id HAVING count(*) > 1
UNION ALL SELECT 'ERROR', 'link', 'unknown_to', CAST(link_id AS VARCHAR) FROM broken WHERE to_node_id NOT IN (SELECT node_id FROM node)
UNION ALL SELECT 'ERROR', 'link', 'not_positive', CAST(link_id AS VARCHAR) FROM broken WHERE lanes <= 0
UNION ALL SELECT 'ERROR', 'demand', 'negative_volume', concat_ws('-', o, d) FROM trips WHERE volume < 0
UNION ALL SELECT 'WARNING', 'demand', 'unknown_origin', concat_ws('-', o, d) FROM trips WHERE o NOT IN (SELECT node_id FROM node)
UNION ALL SELECT 'WARNING', 'link', 'unknown_mode', concat_ws(':', link_id, t) FROM (SELECT link_id, unnest(string_split(allowed_use, ';')) AS t FROM broken WHERE allowed_use NOT IN ('', 'all', 'closed')) WHERE t NOT IN ('AUTOMOBILE', 'BUILDING')""")


def fill_query(s, sf):
    v = links(s, sf)
    holes = v.withColumns({"alpha": F.when(F.col("link_id") % 3 != 0, F.col("alpha")), "beta": F.when(F.col("link_id") % 5 != 0, F.col("beta")), "allowed_use": F.when(F.col("link_id") % 7 != 0, F.col("allowed_use"))})
    return rounded(reports.fill_defaults(holes), "link_id", "allowed_use", alpha="alpha", beta="beta", cutoff_speed="cutoff_speed")


register("fill_defaults", fill_query, with_ctes("link") + " SELECT link_id, CASE WHEN link_id % 7 <> 0 THEN allowed_use ELSE '' END AS allowed_use, round(CASE WHEN link_id % 3 <> 0 THEN alpha ELSE 0.15e0 END, 6) AS alpha, CASE WHEN link_id % 5 <> 0 THEN beta ELSE 4e0 END AS beta, 0.75e0 * free_speed AS cutoff_speed FROM link")
register("link_drop_rules", lambda s, sf: broken(s, sf)[0].filter("lanes > 0 AND capacity >= 0.0001 AND free_speed >= 0.0001").join(F.broadcast(derived(s, sf, "node").select(F.col("node_id").alias("to_node_id"))), "to_node_id", "left_semi").select("link_id", "from_node_id", "to_node_id"), with_ctes("link") + f", {BROKEN_LINK} SELECT link_id, from_node_id, to_node_id FROM broken WHERE lanes > 0 AND to_node_id IN (SELECT node_id FROM node)")


def demand_filter(s, sf):
    kept, out = gmns.known_zones(broken(s, sf)[1], derived(s, sf, "node"))
    both = kept.groupBy("mode").agg(F.sum("volume").alias("kept")).join(out, "mode", "full")
    return both.select("mode", F.coalesce("kept", F.lit(0.0)).alias("kept"), F.coalesce("volume", F.lit(0.0)).alias("dropped"), F.coalesce("rows", F.lit(0)).alias("dropped_rows"))


register("demand_zone_filter", demand_filter, with_ctes("node", "demand") + f", {BROKEN_OD} SELECT mode, sum(CASE WHEN o <= 25 THEN volume ELSE 0 END) AS kept, sum(CASE WHEN o > 25 THEN volume ELSE 0 END) AS dropped, CAST(sum(CASE WHEN o > 25 THEN 1 ELSE 0 END) AS BIGINT) AS dropped_rows FROM trips GROUP BY mode")


def origins_without_exit(s, sf):
    return checks.infeasible_origins(links(s, sf).filter("from_node_id % 6 <> 0"), derived(s, sf, "mode"), derived(s, sf, "demand"))


register("infeasible_origins", origins_without_exit, with_ctes("link", "mode", "demand") + f" SELECT mode, o, sum(volume) AS volume FROM demand t WHERE NOT EXISTS (SELECT 1 FROM link JOIN mode m ON {_CAN.replace('mode)', 'm.mode)')} WHERE m.mode = t.mode AND from_node_id = t.o AND from_node_id % 6 <> 0) GROUP BY mode, o HAVING sum(volume) > 0")
register("origin_totals", lambda s, sf: derived(s, sf, "demand").groupBy("o").agg(F.sum("volume").alias("volume"), F.count("*").alias("pairs")), with_ctes("demand") + " SELECT o, sum(volume) AS volume, count(*) AS pairs FROM demand GROUP BY o")
register("allowed_use_inventory", lambda s, sf: reports.use_classes(links(s, sf), derived(s, sf, "mode")), with_ctes("link", "mode") + f""", k AS (SELECT link_id, allowed_use, sum(CASE WHEN {_CAN} THEN 1 ELSE 0 END) AS k, min(CASE WHEN {_CAN} THEN mode END) AS one, min(CASE WHEN NOT {_CAN} THEN mode END) AS missing, count(*) AS n FROM link, mode GROUP BY ALL)
SELECT CASE WHEN allowed_use IN ('', 'all') THEN 'all' WHEN allowed_use = 'closed' THEN 'closed' WHEN k = n THEN 'all' WHEN k = 1 THEN 'only:' || one WHEN k = n - 1 THEN 'no:' || missing ELSE 'custom' END AS class, count(*) AS links FROM k GROUP BY 1""")
register("plf_inventory", lambda s, sf: rounded(staging.plf_inventory(links(s, sf).withColumn("plf", F.col("plf") * (F.col("link_id") % 5) / 3), 3.0, "link_type"), "link_type", "links", "flat", "out_of_range", "below_hour", mean_plf="mean_plf", min_plf="min_plf", max_plf="max_plf", phi="phi"),
         with_ctes("link") + " SELECT link_type, count(*) AS links, CAST(sum(CASE WHEN p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS flat, CAST(sum(CASE WHEN p <= 0 OR p > 1 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range, CAST(sum(CASE WHEN p * 3 < 1 THEN 1 ELSE 0 END) AS BIGINT) AS below_hour, round(avg(p), 6) AS mean_plf, round(min(p), 6) AS min_plf, round(max(p), 6) AS max_plf, round(avg(p) * 3, 6) AS phi FROM (SELECT *, plf * (link_id % 5) / 3 AS p FROM link) GROUP BY link_type")
register("plf_bounds", lambda s, sf: rounded(links(s, sf), "link_id", bounded=reports.bound_plf(F.col("plf") * (F.col("link_id") % 7 - 1) / 3, 3.0)), with_ctes("link") + " SELECT link_id, round(CASE WHEN plf * (link_id % 7 - 1) / 3 <= 0 THEN 0.25e0 ELSE greatest(least(plf * (link_id % 7 - 1) / 3, 1e0), 1e0 / 3) END, 6) AS bounded FROM link")
register("turn_bans", lambda s, sf: reports.turn_bans(links(s, sf), movements(s, sf), True), with_ctes("link") + " SELECT a.link_id AS ib_link_id, b.link_id AS ob_link_id FROM link a JOIN link b ON a.to_node_id = b.from_node_id WHERE a.from_node_id = b.to_node_id OR (a.link_id + b.link_id) % 17 = 0")


def movements(s, sf):
    a = links(s, sf).select(F.col("link_id").alias("ib_link_id"), F.col("to_node_id").alias("at"))
    b = links(s, sf).select(F.col("link_id").alias("ob_link_id"), F.col("from_node_id").alias("at"))
    return a.join(b, "at").filter("(ib_link_id + ob_link_id) % 17 = 0").select("ib_link_id", "ob_link_id", F.lit(99.0).alias("penalty"))


def origins(s, sf):
    return derived(s, sf, "node").select(F.col("node_id").alias("o"))


def _tree_sql(gate: str = "", table: str = "link", extra: str = "") -> str:
    return with_ctes("link", recursive=True) + extra + f""", sp(o, n, c, via) USING KEY (o, n) AS (
  SELECT node_id, node_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM node
  UNION (SELECT s.o, l.to_node_id, min(s.c + l.cost), arg_min(l.link_id, s.c + l.cost) FROM sp s JOIN {table} l ON l.from_node_id = s.n {gate}
    LEFT JOIN recurring.sp r ON r.o = s.o AND r.n = l.to_node_id WHERE r.c IS NULL OR s.c + l.cost < r.c GROUP BY s.o, l.to_node_id))"""


register("sssp_freeflow", lambda s, sf: paths.skim(links(s, sf), origins(s, sf)), _tree_sql() + " SELECT o, n AS d, c AS cost FROM sp")
register("sssp_first_thru", lambda s, sf: paths.skim(links(s, sf), origins(s, sf), first_thru=6), _tree_sql("AND (s.n >= 6 OR s.n = s.o)") + " SELECT o, n AS d, c AS cost FROM sp")
register("sssp_turn_restricted", lambda s, sf: paths.skim(links(s, sf), origins(s, sf), bans=reports.turn_bans(links(s, sf), movements(s, sf), True)), with_ctes("link", recursive=True) + """, lp(o, k, c) USING KEY (o, k) AS (
  SELECT from_node_id, link_id, cost FROM link
  UNION (SELECT p.o, b.link_id, min(p.c + b.cost) FROM lp p JOIN link a ON a.link_id = p.k JOIN link b ON a.to_node_id = b.from_node_id AND a.from_node_id <> b.to_node_id AND (a.link_id + b.link_id) % 17 <> 0
    LEFT JOIN recurring.lp r ON r.o = p.o AND r.k = b.link_id WHERE r.c IS NULL OR p.c + b.cost < r.c GROUP BY p.o, b.link_id))
SELECT o, to_node_id AS d, min(c) AS cost FROM lp JOIN link ON link_id = k WHERE to_node_id <> o GROUP BY o, to_node_id UNION ALL SELECT node_id, node_id, 0 FROM node""")
FLOWS = _tree_sql() + """, t AS (SELECT mode, o, d, volume FROM demand WHERE volume > 0 AND o <> d),
walk(mode, o, d, volume, n) AS (SELECT mode, o, d, volume, d FROM t UNION ALL SELECT w.mode, w.o, w.d, w.volume, l.from_node_id FROM walk w JOIN sp ON sp.o = w.o AND sp.n = w.n JOIN link l ON l.link_id = sp.via WHERE w.n <> w.o),
steps AS (SELECT w.mode, w.o, w.d, w.volume, sp.via AS link_id FROM walk w JOIN sp ON sp.o = w.o AND sp.n = w.n WHERE w.n <> w.o)"""
FLOWS = FLOWS.replace(with_ctes("link", recursive=True), with_ctes("link", "demand", "mode", recursive=True))


def loaded(s, sf):
    return paths.load(links(s, sf), derived(s, sf, "demand"), modes=False)


def flows(s, sf):
    return paths.load_flows(links(s, sf), derived(s, sf, "demand"), modes=False)


def aon_volume(s, sf):
    return flows(s, sf).join(F.broadcast(derived(s, sf, "mode").select("mode", "pce")), "mode").groupBy("link_id").agg(F.sum(F.col("flow") * F.col("pce")).alias("volume"))


register("aon_volume", aon_volume, FLOWS + " SELECT link_id, sum(volume * pce) AS volume FROM steps JOIN mode USING (mode) GROUP BY link_id")
register("aon_mode_volume", lambda s, sf: flows(s, sf).select("mode", "link_id", "flow"), FLOWS + " SELECT mode, link_id, sum(volume) AS flow FROM steps GROUP BY mode, link_id")
register("aon_route_lengths", lambda s, sf: loaded(s, sf)[1].select("mode", "o", "d", "volume", F.size("links").cast("long").alias("hops"), F.col("cost").cast("long").alias("cost")), FLOWS + " SELECT mode, o, d, any_value(volume) AS volume, count(*) AS hops, any_value((SELECT c FROM sp WHERE sp.o = steps.o AND sp.n = steps.d)) AS cost FROM steps GROUP BY mode, o, d")


def minutes_pairs(s, sf):
    return loaded(s, sf)[1].withColumn("cost", F.col("cost") / 1e7)


def lengths(s, sf):
    return links(s, sf).select("link_id", "length")


_PAIRS = FLOWS + ", pairs AS (SELECT mode, steps.o, steps.d, any_value(steps.volume) AS volume, sum(length) AS miles, any_value(sp.c) / 1e7 AS cost FROM steps JOIN link USING (link_id) JOIN sp ON sp.o = steps.o AND sp.n = steps.d GROUP BY mode, steps.o, steps.d)"
register("od_performance", lambda s, sf: rounded(reports.pair_lengths(minutes_pairs(s, sf), lengths(s, sf)), "mode", "o", "d", volume="volume", miles="miles", minutes="cost"), _PAIRS + " SELECT mode, o, d, volume, round(miles, 6) AS miles, round(cost, 6) AS minutes FROM pairs")
register("system_performance", lambda s, sf: rounded(reports.system_performance(minutes_pairs(s, sf), lengths(s, sf), derived(s, sf, "mode")), "mode", digits=4, volume="volume", pmt="pmt", pht="pht", mean_miles="mean_miles", mean_minutes="mean_minutes"), _PAIRS + " SELECT mode, round(sum(volume), 4) AS volume, round(sum(volume * miles * occ), 4) AS pmt, round(sum(volume * cost * occ / 60), 4) AS pht, round(sum(volume * miles) / sum(volume), 4) AS mean_miles, round(sum(volume * cost) / sum(volume), 4) AS mean_minutes FROM pairs JOIN mode USING (mode) GROUP BY mode")
for _end, _other, _name in (("o", "d", "origin"), ("d", "o", "destination")):
    register(f"{_name}_accessibility", lambda s, sf, e=_end: rounded(reports.accessibility(minutes_pairs(s, sf), derived(s, sf, "node"), e, lengths(s, sf)), "zone_id", "partners", digits=4, volume="volume", mean_miles="mean_miles", mean_minutes="mean_minutes"),
             _PAIRS + f" SELECT zone_id, count(DISTINCT {_other}) AS partners, round(coalesce(sum(volume), 0), 4) AS volume, round(coalesce(sum(volume * miles) / sum(volume), 0), 4) AS mean_miles, round(coalesce(sum(volume * cost) / sum(volume), 0), 4) AS mean_minutes FROM node LEFT JOIN pairs ON {_end} = zone_id GROUP BY zone_id")


def cut_network(s, sf):
    return links(s, sf).filter("NOT (from_node_id = 13 OR to_node_id = 25)")


register("inaccessible_od", lambda s, sf: paths.load(cut_network(s, sf), derived(s, sf, "demand"), modes=False)[1].filter("links IS NULL").select("mode", "o", "d", "volume"), _tree_sql("AND l.from_node_id <> 13 AND l.to_node_id <> 25").replace(with_ctes("link", recursive=True), with_ctes("link", "demand", recursive=True)) + " SELECT mode, d.o, d.d, volume FROM demand d WHERE volume > 0 AND d.o <> d.d AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.o = d.o AND sp.n = d.d)")
register("reachability", lambda s, sf: paths.skim(cut_network(s, sf), origins(s, sf)).groupBy("o").agg(F.count("*").alias("reached")), _tree_sql("AND l.from_node_id <> 13 AND l.to_node_id <> 25") + " SELECT o, count(*) AS reached FROM sp GROUP BY o")
register("zone_accessibility", lambda s, sf: rounded(paths.skim(links(s, sf), origins(s, sf)).filter("o <> d").groupBy("o").agg((F.avg("cost") / 1e7).alias("m")), "o", digits=4, mean_minutes="m"), _tree_sql() + " SELECT o, round(avg(c) / 1e7, 4) AS mean_minutes FROM sp WHERE o <> n GROUP BY o")


def link_performance(s, sf):
    v = links(s, sf).drop("volume").join(aon_volume(s, sf), "link_id", "left").fillna(0.0, ["volume"])
    return rounded(reports.link_performance(v), "link_id", "from_node_id", "to_node_id", digits=5, volume="volume", **_PERF)


_AON = FLOWS + ", vol AS (SELECT link_id, sum(volume * pce) AS vol FROM steps JOIN mode USING (mode) GROUP BY link_id), link2 AS (SELECT link.* REPLACE (coalesce(vol, 0) AS volume) FROM link LEFT JOIN vol USING (link_id))" + LOADED[len(with_ctes("link")):].replace("FROM link)", "FROM link2)") + f", p AS (SELECT *, {_BY_TYPE} AS tt FROM v)"
register("link_performance", link_performance, _AON + " SELECT link_id, from_node_id, to_node_id, round(volume, 5) AS volume, round(D, 5) AS D, round(x, 5) AS doc, round(tt, 5) AS travel_time, round(length / greatest(1e-9, tt) * 60, 5) AS speed, round(volume * length, 5) AS VMT, round(volume * tt / 60, 5) AS VHT FROM p")


def line_search_grid(s, sf):
    """Slope of the objective at each of the 33 steps from the observed to the loaded volumes, in one job."""
    y = aon_volume(s, sf).withColumnRenamed("volume", "y")
    v = links(s, sf).join(y, "link_id", "left").fillna(0.0, ["y"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(32)))).withColumn("dir", F.col("y") - F.col("volume")).withColumn("volume", F.col("volume") + F.col("k") / 32 * F.col("dir"))
    return reports.with_time(v).groupBy("k").agg(F.round(F.sum(F.col("travel_time") * F.col("dir")) / 1e6, 4).alias("slope"))


register("line_search_grid", line_search_grid, FLOWS + ", vol AS (SELECT link_id, sum(volume * pce) AS vol FROM steps JOIN mode USING (mode) GROUP BY link_id), link2 AS (SELECT link.* REPLACE (volume + k / 32 * (coalesce(vol, 0) - volume) AS volume), k, coalesce(vol, 0) - volume AS dir FROM link LEFT JOIN vol USING (link_id), (SELECT unnest(range(0, 33)) AS k) g)" + LOADED[len(with_ctes("link")):].replace("FROM link)", "FROM link2)") + f", p AS (SELECT *, {_BY_TYPE} AS tt FROM v) SELECT CAST(k AS INT) AS k, round(sum(tt * dir) / 1e6, 4) AS slope FROM p GROUP BY k")


def equilibrium(method: str):
    def run(s, sf):
        r = solver.assign(links(s, sf), derived(s, sf, "demand"), derived(s, sf, "mode"), solver.Settings(iterations=6, method=method))
        return s.createDataFrame([(i + 1, float(g), float(a)) for i, (g, a) in enumerate(zip(r.gaps, r.steps, strict=True))], "iteration int, gap_percent double, step double")

    return run


for _m in ("fw", "cfw", "bfw"):
    register(f"equilibrium_{_m}", equilibrium(_m))

# comparisons and stage reports
register("compare_stats", lambda s, sf: rounded(reports.fit(links(s, sf), "volume", "ref_volume"), "n", digits=5, r2="r2", rmse="rmse", rmse_percent="rmse_percent", sum_a="sum_a", sum_b="sum_b"), with_ctes("link") + " SELECT count(*) AS n, round(pow(corr(volume, ref_volume), 2), 5) AS r2, round(sqrt(avg(pow(volume - ref_volume, 2))), 5) AS rmse, round(sqrt(avg(pow(volume - ref_volume, 2))) / avg(ref_volume) * 100, 5) AS rmse_percent, sum(volume) AS sum_a, sum(ref_volume) AS sum_b FROM link")
_GROUP = "CASE " + " ".join(f"WHEN r >= {lo} AND r < {hi} THEN {lo}" for lo, hi, _ in reports.VOLUME_GROUPS if hi) + f" ELSE {reports.VOLUME_GROUPS[-1][0]} END"
_LIMIT = "CASE g " + " ".join(f"WHEN {lo} THEN {most}e0" for lo, _, most in reports.VOLUME_GROUPS) + " END"
register("rmse_by_volume_group", lambda s, sf: rounded(reports.fit_by_group(links(s, sf).withColumns({"v": F.col("volume") * 9, "r": F.col("ref_volume") * 10}), "v", "r"), "g", "n", "holds", digits=5, error="error", limit="limit", ratio="ratio"),
         with_ctes("link") + f", v AS (SELECT volume * 9 AS v, ref_volume * 10 AS r FROM link), w AS (SELECT *, {_GROUP} AS g FROM v) SELECT g, count(*) AS n, sqrt(avg(pow(v - r, 2))) / avg(r) <= any_value({_LIMIT}) AS holds, round(sqrt(avg(pow(v - r, 2))) / avg(r), 5) AS error, any_value({_LIMIT}) AS \"limit\", round(sum(v) / sum(r), 5) AS ratio FROM w GROUP BY g")
register("band_share", lambda s, sf: rounded(compare.band(links(s, sf)), "closed_leak", within="within", ratio="ratio", bias="bias"), with_ctes("link") + " SELECT round(avg(CASE WHEN abs(volume - ref_volume) <= 0.1e0 * ref_volume THEN 1e0 ELSE 0e0 END), 6) AS within, sum(CASE WHEN allowed_use = 'closed' THEN volume ELSE 0e0 END) AS closed_leak, round(sum(volume) / sum(ref_volume), 6) AS ratio, round(avg(volume - ref_volume), 6) AS bias FROM link")
register("r1_lane_miles", lambda s, sf: rounded(workflow.lane_miles(links(s, sf), "link_type", "area_type"), "link_type", "area_type", "links", lane_miles="lane_miles"), with_ctes("link") + " SELECT link_type, area_type, count(*) AS links, round(sum(length * lanes), 6) AS lane_miles FROM link GROUP BY ALL")
register("r1_reverse_paired", lambda s, sf: workflow.reverse_paired(links(s, sf).filter("link_id % 7 <> 0")), with_ctes("link") + ", v AS (SELECT DISTINCT from_node_id AS f, to_node_id AS t FROM link WHERE link_id % 7 <> 0) SELECT count(*) AS directed, (SELECT count(*) FROM v a JOIN v b ON a.f = b.t AND a.t = b.f) AS paired FROM v")
register("r2_od_by_class", lambda s, sf: workflow.demand_by_class(derived(s, sf, "demand")), with_ctes("demand") + " SELECT mode, count(CASE WHEN volume <> 0 THEN 1 END) AS pairs, sum(volume) AS trips, sum(CASE WHEN o = d THEN volume ELSE 0 END) AS within FROM demand GROUP BY mode")
register("r2_use_groups", lambda s, sf: workflow.use_groups(links(s, sf)), with_ctes("link") + " SELECT CASE allowed_use WHEN '' THEN 'all' ELSE allowed_use END AS allowed_use, count(*) AS links FROM link GROUP BY 1")
register("r3_vdf_by_code", lambda s, sf: rounded(workflow.parameters_by_code(links(s, sf)), "vdf_type", "links", alpha="alpha", beta="beta", median_capacity="median_capacity"), with_ctes("link") + " SELECT vdf_type, count(*) AS links, round(avg(alpha), 6) AS alpha, round(avg(beta), 6) AS beta, round(quantile_cont(capacity, 0.5), 6) AS median_capacity FROM link GROUP BY vdf_type")


def holed(s, sf):
    k = F.col("link_id")
    return links(s, sf).withColumns({"capacity": F.when(k % 11 != 0, F.col("capacity")), "alpha": F.when(k % 5 != 0, F.col("alpha"))})


register("r3_join_rate", lambda s, sf: rounded(workflow.join_rate(holed(s, sf)), "links", "no_capacity", "no_parameters", "gate", rate="rate"), with_ctes("link") + ", n AS (SELECT count(*) AS links, count(CASE WHEN link_id % 11 = 0 THEN 1 END) AS no_capacity, count(CASE WHEN link_id % 5 = 0 THEN 1 END) AS no_parameters FROM link) SELECT *, CASE WHEN no_capacity = 0 AND no_parameters = 0 THEN 'PASS' WHEN 100e0 * (links - greatest(no_capacity, no_parameters)) / links > 95 THEN 'WARN' ELSE 'FAIL' END AS gate, round(100e0 * (links - greatest(no_capacity, no_parameters)) / links, 6) AS rate FROM n")
register("r4_plf_by_type", lambda s, sf: rounded(workflow.plf_by(links(s, sf), "link_type"), "link_type", "low", "high", mean="mean"), with_ctes("link") + " SELECT link_type, round(avg(plf), 6) AS mean, min(plf) AS low, max(plf) AS high FROM link GROUP BY link_type")
register("r4_plf_gate", lambda s, sf: workflow.plf_gate(links(s, sf).withColumn("plf", F.when(F.col("link_type") > 0, F.lit(1.0))), 3.0), with_ctes("link") + " SELECT min(CASE WHEN link_type > 0 THEN 1e0 END) = 1 AND max(CASE WHEN link_type > 0 THEN 1e0 END) = 1 AS flat, CASE WHEN min(CASE WHEN link_type > 0 THEN 1e0 END) = 1 THEN 'FAIL' ELSE 'PASS' END AS gate FROM link")


def reported(s, sf):
    """A run whose reported miles are a little off, so that the identities have something to find."""
    p = reports.link_performance(links(s, sf).withColumn("vdf_type", F.lit(0)))
    return p.withColumns({"VMT": F.when(F.col("link_id") % 3 == 0, 1.2).otherwise(1.0) * F.col("VMT"), "speed": F.when(F.col("link_id") % 10 == 0, 2.0).otherwise(1.0) * F.col("speed")})


_REPORTED = LOADED + f", p AS (SELECT *, {BPR} AS tt FROM v), q AS (SELECT *, CASE WHEN link_id % 3 = 0 THEN 1.2e0 ELSE 1e0 END * volume * length AS VMT, CASE WHEN link_id % 10 = 0 THEN 2e0 ELSE 1e0 END * length / tt * 60 AS speed FROM p)"
register("r5_identities", lambda s, sf: rounded(workflow.identities(reported(s, sf)), "out_of_bounds", "gate", vmt_off="vmt_off", vht_off="vht_off"), _REPORTED + ", r AS (SELECT abs(sum(VMT) - sum(volume * length)) / sum(VMT) * 100 AS off, CAST(sum(CASE WHEN speed < 0 OR speed > free_speed * 1.05e0 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_bounds FROM q) SELECT out_of_bounds, CASE WHEN off <= 1 AND out_of_bounds = 0 THEN 'PASS' ELSE 'FAIL' END AS gate, round(off, 6) AS vmt_off, 0e0 AS vht_off FROM r")
register("r5_reference", lambda s, sf: rounded(workflow.against_reference(links(s, sf)), "n", r2="r2", slope="slope"), with_ctes("link") + " SELECT count(*) AS n, round(regr_r2(volume, ref_volume), 6) AS r2, round(sum(volume * ref_volume) / sum(ref_volume * ref_volume), 6) AS slope FROM link")
register("r5_problem_links", lambda s, sf: workflow.problem_links(links(s, sf)).select("link_id", "volume", "ref_volume"), with_ctes("link") + " SELECT link_id, volume, ref_volume FROM link WHERE ref_volume > 0 AND abs(volume - ref_volume) > 0.5e0 * ref_volume")


def mile_groups(s, sf):
    p = reports.link_performance(links(s, sf).withColumn("vdf_type", F.lit(0))).withColumns({"ref_vmt": F.col("ref_volume") * F.col("length"), "ref_vht": F.col("ref_volume") * F.col("fftt") / 60})
    return workflow.miles_by_group(p, "link_type", "area_type")


_GROUPS = LOADED + f", g AS (SELECT link_type, area_type, sum(volume * length) AS VMT, sum(ref_volume * length) AS ref_vmt, sum(volume * {BPR} / 60) AS VHT, sum(ref_volume * fftt / 60) AS ref_vht FROM v GROUP BY link_type, area_type), h AS (SELECT *, (VMT - ref_vmt) / ref_vmt * 100 AS difference, ref_vmt >= 0.01e0 * sum(ref_vmt) OVER () AND VMT > 0 AS material FROM g)"
register("r6_vmt_by_group", lambda s, sf: rounded(mile_groups(s, sf), "link_type", "area_type", "material", VMT="VMT", ref_vmt="ref_vmt", VHT="VHT", ref_vht="ref_vht", difference="difference"), _GROUPS + " SELECT link_type, area_type, material, round(VMT, 6) AS VMT, round(ref_vmt, 6) AS ref_vmt, round(VHT, 6) AS VHT, round(ref_vht, 6) AS ref_vht, round(difference, 6) AS difference FROM h")
register("r6_gate", lambda s, sf: rounded(workflow.miles_gate(mile_groups(s, sf)), "gate", difference="difference", worst="worst"), _GROUPS + ", t AS (SELECT (sum(VMT) - sum(ref_vmt)) / sum(ref_vmt) * 100 AS d, max(CASE WHEN material THEN abs(difference) END) AS w FROM h) SELECT CASE WHEN abs(d) <= 5 THEN 'PASS' ELSE 'WARN' END AS gate, round(d, 6) AS difference, round(w, 6) AS worst FROM t")
register("top_congested", lambda s, sf: rounded(reports.with_load(links(s, sf)), "link_id", doc="doc").orderBy(F.desc("doc"), "link_id").limit(5), LOADED + " SELECT link_id, round(x, 6) AS doc FROM v ORDER BY round(x, 6) DESC, link_id LIMIT 5")
register("run_report_by_type", lambda s, sf: rounded(reports.link_performance(links(s, sf)).groupBy("link_type").agg(F.count("*").alias("links"), F.sum("VMT").alias("v"), F.sum("VHT").alias("h")), "link_type", "links", digits=4, VMT="v", VHT="h"), TIMED + " SELECT link_type, count(*) AS links, round(sum(volume * length), 4) AS VMT, round(sum(volume * tt / 60), 4) AS VHT FROM p GROUP BY link_type")
register("enforcement_failures", lambda s, sf: flows(s, sf).join(F.broadcast(links(s, sf).select("link_id", "allowed_use")), "link_id").filter(~reports.allowed(F.col("allowed_use"), F.col("mode")) & (F.col("flow") > 0.01)).select("mode", "link_id", "flow"), FLOWS + f" SELECT mode, link_id, sum(steps.volume) AS flow FROM steps JOIN link USING (link_id) WHERE NOT {_CAN} GROUP BY mode, link_id")

# edits
_PROD = "prod AS (SELECT o AS zone_id, sum(volume) AS trips FROM demand GROUP BY o)"
_GRID = with_ctes("node", "demand") + f""", {_PROD}, r AS (SELECT zone_id, x, y, coalesce(trips, 0) AS trips, row_number() OVER (ORDER BY x, zone_id) - 1 AS ix, row_number() OVER (ORDER BY y, zone_id) - 1 AS iy FROM node LEFT JOIN prod USING (zone_id)),
c AS (SELECT zone_id, trips, (SELECT count(*) FROM (SELECT x AS cut FROM r WHERE ix IN (8, 16)) WHERE r0.x >= cut) AS cx, (SELECT count(*) FROM (SELECT y AS cut FROM r WHERE iy IN (8, 16)) WHERE r0.y >= cut) AS cy FROM r r0),
rep AS (SELECT cx, cy, (list(zone_id ORDER BY trips DESC, zone_id))[1] AS rep_id FROM c GROUP BY cx, cy), m AS (SELECT zone_id, rep_id FROM c JOIN rep USING (cx, cy))"""


def zone_map(s, sf):
    trips = derived(s, sf, "demand").groupBy(F.col("o").alias("zone_id")).agg(F.sum("volume").alias("trips"))
    return reports.grid_zones(derived(s, sf, "node"), trips, 9)


register("superzone_grid", zone_map, _GRID + " SELECT zone_id, rep_id FROM m")
register("superzone_od", lambda s, sf: reports.regroup_demand(derived(s, sf, "demand"), zone_map(s, sf)), _GRID + " SELECT mode, a.rep_id AS o, b.rep_id AS d, sum(volume) AS volume FROM demand JOIN m a ON a.zone_id = o JOIN m b ON b.zone_id = d WHERE a.rep_id <> b.rep_id GROUP BY ALL")


def demand_changes(s, sf):
    d = derived(s, sf, "demand")
    base = d.filter("(o + d) % 3 = 0").withColumn("volume", F.col("volume") + F.when(F.col("o") % 2 == 0, 3).otherwise(-1))
    more, less = solver.demand_difference(d, base)
    return more.select("mode", "o", "d", F.col("volume").alias("diff")).unionByName(less.select("mode", "o", "d", (-F.col("volume")).alias("diff")))


register("demand_diff", demand_changes, with_ctes("demand") + " SELECT * FROM (SELECT mode, o, d, volume - CASE WHEN (o + d) % 3 = 0 THEN volume + CASE WHEN o % 2 = 0 THEN 3 ELSE -1 END ELSE 0 END AS diff FROM demand) WHERE diff <> 0")
register("mode_split", lambda s, sf: derived(s, sf, "demand").groupBy("o", "d").agg(F.sum("volume").alias("v")).crossJoin(F.broadcast(s.createDataFrame([("sov", 0.5), ("hov", 0.25), ("truck", 0.25)], "token string, share double"))).select("o", "d", "token", (F.col("v") * F.col("share")).alias("volume")), with_ctes("demand") + " SELECT o, d, token, v * share AS volume FROM (SELECT o, d, sum(volume) AS v FROM demand GROUP BY o, d), (VALUES ('sov', 0.5e0), ('hov', 0.25e0), ('truck', 0.25e0)) s(token, share)")
register("renumber_zones_first", lambda s, sf: reports.renumber(derived(s, sf, "node").withColumn("zone_id", F.when(F.col("node_id") % 3 == 0, F.col("node_id")).otherwise(0))), with_ctes("node") + " SELECT node_id, row_number() OVER (ORDER BY CASE WHEN node_id % 3 = 0 THEN 0 ELSE 1 END, node_id) AS new_id FROM node")


def runs(s, sf):
    v = links(s, sf)
    two = [v.select(F.lit(k).alias("iterations"), "link_id", F.col(c).alias("volume"), "length") for k, c in ((1, "volume"), (10, "ref_volume"))]
    return two[0].unionByName(two[1]).unionByName(v.select(F.lit(20).alias("iterations"), "link_id", ((F.col("volume") + F.col("ref_volume")) / 2).alias("volume"), "length"))


register("convergence_delta", lambda s, sf: compare.convergence(runs(s, sf)), with_ctes("link") + " SELECT 1 AS iterations, sum(volume * length) AS vmt, CAST(NULL AS DOUBLE) AS max_delta FROM link UNION ALL SELECT 10, sum(ref_volume * length), max(abs(volume - ref_volume)) FROM link UNION ALL SELECT 20, sum((volume + ref_volume) / 2 * length), max(abs((volume + ref_volume) / 2 - ref_volume)) FROM link")
register("two_runs", lambda s, sf: rounded(compare.two_runs(links(s, sf), links(s, sf).filter("link_id % 4 <> 0").withColumn("volume", F.col("ref_volume"))), "n", "max_delta", digits=5, r2="r2", rmse="rmse", vmt_a="vmt_a", vmt_b="vmt_b"), with_ctes("link") + " SELECT count(*) AS n, max(abs(volume - ref_volume)) AS max_delta, round(pow(corr(volume, ref_volume), 2), 5) AS r2, round(sqrt(avg(pow(volume - ref_volume, 2))), 5) AS rmse, round(sum(volume * length), 5) AS vmt_a, round(sum(ref_volume * length), 5) AS vmt_b FROM link WHERE link_id % 4 <> 0")


def doubled(s, sf):
    v = links(s, sf)
    return v.unionByName(v.filter("link_id % 3 = 0").withColumns({"link_id": F.col("link_id") + 100_000, "lanes": F.col("lanes") + 5}))


register("performance_by_ends", lambda s, sf: compare.performance_of_links(links(s, sf).select("from_node_id", "to_node_id", "volume"), doubled(s, sf).filter("link_id % 5 <> 0"), "lanes"), with_ctes("link") + ", w AS (SELECT link_id, from_node_id AS f, to_node_id AS t, lanes FROM link UNION ALL SELECT link_id + 100000, from_node_id, to_node_id, lanes + 5 FROM link WHERE link_id % 3 = 0), z AS (SELECT f, t, arg_max(lanes, link_id) AS lanes FROM w WHERE link_id % 5 <> 0 GROUP BY f, t) SELECT from_node_id, to_node_id, volume, z.lanes FROM link LEFT JOIN z ON f = from_node_id AND t = to_node_id")
register("performance_by_id", lambda s, sf: compare.performance_of_ids(links(s, sf).select("link_id", "volume"), links(s, sf).filter("link_id % 5 <> 0"), "capacity"), with_ctes("link") + " SELECT link_id, volume, capacity FROM link WHERE link_id % 5 <> 0")
register("volumes_with_reference", lambda s, sf: compare.volumes_with_reference(links(s, sf), links(s, sf).withColumn("factype", F.col("area_type"))).select("from_node_id", "to_node_id", "volume", "ref_volume"), with_ctes("link") + " SELECT from_node_id, to_node_id, volume, ref_volume FROM link WHERE area_type <> 0")
register("benchmark_medians", lambda s, sf: compare.benchmark(links(s, sf).select(F.col("link_type").alias("facility"), F.col("area_type").alias("area"), "free_speed"), s.createDataFrame([(f, a, 36.0 + f + a) for f in (1, 2, 3) for a in (0, 1, 2)], "facility long, area long, expected double"), F.col("free_speed"), F.lit(3.0)), with_ctes("link") + ", m AS (SELECT link_type AS facility, area_type AS area, quantile_cont(free_speed, 0.5) AS median, count(*) AS links FROM link GROUP BY ALL) SELECT *, 36e0 + facility + area AS expected, abs(median - (36e0 + facility + area)) <= 3 AS within FROM m WHERE facility <= 3")

# parameters by facility, adapted tables
_CONIC = "CASE link_type " + " ".join(f"WHEN {k} THEN {v}e0" for k, v in staging.CONIC_A.items()) + " END"
register("stage_conic", lambda s, sf: rounded(reports.with_time(staging.with_conic(links(s, sf), "link_type").withColumn("beta", F.lit(9.0))), "link_id", "vdf_type", travel_time="travel_time"), LOADED + f", c AS (SELECT *, {_CONIC} AS a FROM v) SELECT link_id, CASE WHEN a IS NULL THEN 0 ELSE 1 END AS vdf_type, round(fftt * (2 + sqrt(a * a * (1 - x) * (1 - x) + pow((2 * a - 1) / (2 * a - 2), 2)) - a * (1 - x) - (2 * a - 1) / (2 * a - 2)), 6) AS travel_time FROM c")
_Q = lambda i: f"CASE link_type WHEN 1 THEN {staging.QUEUE[1][i]}e0 WHEN 2 THEN {staging.QUEUE[2][i]}e0 ELSE {staging.QUEUE_OTHERS[i]}e0 END"
register("stage_queue", lambda s, sf: rounded(reports.with_time(staging.with_queue(links(s, sf), "link_type")), "link_id", digits=5, travel_time="travel_time"), with_ctes("link") + f""", p AS (SELECT *, {_Q(0)} AS al, {_Q(1)} AS be, {_Q(3)} AS cd, {_Q(4)} AS n, volume / lanes / {_Q(6)} / capacity AS x, 0.75e0 * free_speed AS vc FROM link),
q AS (SELECT *, {REF} AS ref, cd * pow(x, n) AS pp FROM p), r AS (SELECT *, ref / (1 + al * pow(x, be)) AS qs FROM q)
SELECT link_id, round(length / greatest(0.1e0, CASE WHEN pp > 1 THEN qs ELSE pp * qs + (1 - pp) * (ref + free_speed) / 2 END) * 60, 5) AS travel_time FROM r""")
register("stage_modified_bpr", lambda s, sf: rounded(staging.with_modified_bpr(links(s, sf).withColumns({"facility": F.col("link_id") % 15, "weave": F.col("link_id") % 2, "lanes": F.col("lanes") + 3})), "link_id", linear="linear", alpha="alpha", beta="beta", capacity="capacity"),
         with_ctes("link") + ", w AS (SELECT link_id, link_id % 15 AS f, link_id % 2 = 1 AS w, capacity, lanes + 3 AS lanes FROM link), t AS (SELECT *, CASE WHEN w AND f IN (1, 4, 5, 6) THEN 9 WHEN f IN (1, 4, 5, 6) THEN 1 WHEN f IN (7, 8, 9) THEN 7 WHEN f IN (0, 2, 3) THEN f ELSE 10 END AS c FROM w) SELECT link_id, CASE c WHEN 9 THEN 0.2e0 WHEN 0 THEN 0e0 WHEN 2 THEN 0e0 WHEN 3 THEN 0e0 ELSE 0.1e0 END AS linear, CASE c WHEN 9 THEN 1.25e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 1e0 WHEN 3 THEN 1.25e0 WHEN 7 THEN 1e0 WHEN 0 THEN 0.15e0 ELSE 0.45e0 END AS alpha, CASE c WHEN 9 THEN 5.5e0 WHEN 1 THEN 6e0 ELSE 4e0 END AS beta, round(CASE WHEN w AND lanes > 4 THEN capacity * pow(0.98e0, lanes - 1) ELSE capacity END, 6) AS capacity FROM t")
_CODES = "CASE code " + " ".join(f"WHEN {k} THEN {v[1]}" for k, v in staging.BY_CODE.items()) + " END"
register("stage_code_table", lambda s, sf: rounded(staging.with_code_table(links(s, sf).withColumn("vdf_code", 100 * (1 + F.col("area_type")) + F.col("link_id") % 12)), "link_id", "recoded", alpha="alpha"), with_ctes("link") + f", c AS (SELECT *, 100 * (1 + area_type) + link_id % 12 AS code FROM link) SELECT link_id, {_CODES} IS NOT NULL AS recoded, round(coalesce({_CODES}, alpha), 6) AS alpha FROM c")
register("stage_observed_plf", lambda s, sf: rounded(links(s, sf), "link_id", plf=staging.observed_plf(F.col("volume"), F.col("capacity"), F.col("ref_volume") / 1000)), with_ctes("link") + ", p AS (SELECT *, volume / (4 * capacity * (ref_volume / 1000)) AS p FROM link) SELECT link_id, round(CASE WHEN volume > 0 AND ref_volume > 0 AND p >= 0.3e0 AND p <= 1.5e0 THEN p ELSE 0.8503e0 END, 6) AS plf FROM p")
register("stage_prohibited_use", lambda s, sf: links(s, sf).select("link_id", staging.prohibited_use(F.col("link_id") % 14).alias("allowed_use")), with_ctes("link") + " SELECT link_id, CASE link_id % 14 WHEN 2 THEN 'hov2;hov3' WHEN 11 THEN 'hov2;hov3' WHEN 6 THEN 'hov3' WHEN 4 THEN 'trk' WHEN 10 THEN 'trk' ELSE '' END AS allowed_use FROM link")


def as_text(s, sf):
    """The links as a file would have them: text, other names, some holes."""
    k = F.col("link_id")
    return links(s, sf).select(k.cast("string").alias("LINK_ID"), F.col("from_node_id").cast("string").alias("From_Node_ID"), F.col("to_node_id").cast("string").alias("to_node_id"), F.when(k % 5 == 0, "0").otherwise(F.col("lanes").cast("string")).alias("Lanes"), F.when(k % 3 == 0, "").otherwise(F.col("capacity").cast("string")).alias("capacity"), F.col("free_speed").cast("string").alias("FREE_SPEED"), F.when(k % 2 == 0, F.lit("7.5")).otherwise("").alias("VDF_length_mi"), F.col("length").cast("string").alias("length"), F.when(k % 4 == 0, "Motorway ").otherwise("lane").alias("facility_type"))


register("adapt_links", lambda s, sf: staging.adapt_links(as_text(s, sf)).select("link_id", "lanes", "capacity", F.col("vdf_free_speed_mph").cast("double").alias("speed"), F.col("vdf_length_mi").cast("double").alias("miles")), with_ctes("link") + " SELECT CAST(link_id AS VARCHAR) AS link_id, CASE WHEN link_id % 5 = 0 THEN 1e0 ELSE lanes END AS lanes, CASE WHEN link_id % 3 <> 0 THEN capacity WHEN link_id % 4 = 0 THEN 2000e0 ELSE 1000e0 END AS capacity, free_speed AS speed, CASE WHEN link_id % 2 = 0 THEN 7.5e0 ELSE length END AS miles FROM link")


def period_table(s, sf):
    settings = {"iterations": 1, "agent_types": {}, "periods": {"2": {"name": "NT", "time_period": "1800_0600"}}, "demand_files": []}
    v = links(s, sf).select("link_id", "from_node_id", "to_node_id", F.col("link_type").cast("string").alias("link_type"), "lanes", "free_speed", "length", F.col("fftt").alias("VDF_fftt2"), (F.col("capacity") * 10).alias("VDF_cap2"), F.lit(1.0).alias("VDF_cap1"), F.col("alpha").alias("VDF_alpha2"), F.col("beta").alias("VDF_beta2"))
    return staging.single_period(v, derived(s, sf, "node").withColumn("pos", -F.col("node_id")), settings, "nt")[0]


register("single_period", lambda s, sf: rounded(period_table(s, sf), "link_id", vdf_plf="vdf_plf", capacity="capacity", miles="vdf_length_mi", cutoff_speed="cutoff_speed"), with_ctes("link") + " SELECT link_id, CASE WHEN link_type = 2 THEN 0.39e0 ELSE 0.4e0 END AS vdf_plf, round(round(capacity * 10 / (lanes * 12e0), 3), 6) AS capacity, round(round(fftt * free_speed / 60, 6), 6) AS miles, round(round(free_speed * 0.75e0, 3), 6) AS cutoff_speed FROM link")


def text_tables(s, sf):
    """Node and link files with faults of every kind."""
    n = derived(s, sf, "node").select(F.when(F.col("node_id") == 9, "9x").otherwise(F.col("node_id").cast("string")).alias("node_id"), F.col("zone_id").cast("string").alias("zone_id"), F.lit("0").alias("x_coord"))
    k = F.col("link_id")
    v = links(s, sf).orderBy("link_id").select(k.cast("string").alias("link_id"), F.when(k % 31 == 0, "?").otherwise(F.col("from_node_id").cast("string")).alias("from_node_id"), F.when(k % 17 == 0, "99").otherwise(F.col("to_node_id").cast("string")).alias("to_node_id"), F.when(k % 13 == 0, "0").otherwise(F.col("lanes").cast("string")).alias("lanes"), F.lit("10").alias("capacity"), F.col("free_speed").cast("string").alias("free_speed"), F.col("vdf_type").cast("string").alias("vdf_type"), F.when(k % 2 == 0, "1").alias("vdf_cp"), F.lit("1").alias("vdf_cd"), F.lit("1").alias("vdf_n"), F.lit("4").alias("vdf_s"), F.lit("1").alias("vdf_plf"), "allowed_use")
    return n, v


_TEXT = with_ctes("node", "link")
register("check_files", lambda s, sf: checks.check_tables(*text_tables(s, sf), ["AUTOMOBILE", "BUILDING"], 3.0), _TEXT + """
SELECT 'ERROR' AS severity, 'node' AS file, 'missing_column' AS code, 'y_coord' AS item
UNION ALL SELECT 'ERROR', 'link', 'not_a_number', 'from_node_id:' || link_id FROM link WHERE link_id % 31 = 0
UNION ALL SELECT 'ERROR', 'link', 'unknown_to', CAST(link_id AS VARCHAR) FROM link WHERE link_id % 17 = 0
UNION ALL SELECT 'ERROR', 'link', 'not_positive', 'lanes:' || link_id FROM link WHERE link_id % 13 = 0
UNION ALL SELECT 'WARNING', 'link', 'queue_parameter', 'vdf_cp:' || link_id FROM link WHERE vdf_type = 2 AND link_id % 2 <> 0
UNION ALL SELECT 'WARNING', 'link', 'unknown_mode', link_id || ':' || t FROM (SELECT link_id, unnest(string_split(allowed_use, ';')) AS t FROM link WHERE allowed_use NOT IN ('', 'all', 'closed')) WHERE t NOT IN ('AUTOMOBILE', 'BUILDING')
UNION ALL SELECT 'WARNING', 'link', 'flat_plf', 'vdf_plf'""")
register("check_movements", lambda s, sf: checks.check_movements(movements(s, sf).withColumn("ob_link_id", F.when(F.col("ib_link_id") % 5 == 0, -F.col("ob_link_id")).otherwise(F.col("ob_link_id"))), links(s, sf)), with_ctes("link") + " SELECT 'ERROR' AS severity, 'movement' AS file, 'unknown_ob_link_id' AS code, CAST(-b.link_id AS VARCHAR) AS item FROM link a JOIN link b ON a.to_node_id = b.from_node_id WHERE (a.link_id + b.link_id) % 17 = 0 AND a.link_id % 5 = 0")
register("fill_log", lambda s, sf: checks.fill_with_log(holed(s, sf).withColumn("allowed_use", F.when(F.col("link_id") % 7 == 0, " ").otherwise("all")))[1], with_ctes("link") + " SELECT 'alpha' AS \"column\", count(*) AS filled FROM link WHERE link_id % 5 = 0 UNION ALL SELECT 'allowed_use', count(*) FROM link WHERE link_id % 7 = 0")
register("zone_degrees", lambda s, sf: checks.zone_degrees(links(s, sf), derived(s, sf, "mode"), derived(s, sf, "node")), with_ctes("node", "link", "mode") + f" SELECT mode, zone_id, (SELECT count(*) FROM link WHERE from_node_id = zone_id AND {_CAN}) AS out_links, (SELECT count(*) FROM link WHERE to_node_id = zone_id AND {_CAN}) AS in_links FROM node, mode")


def declared_query(s, sf):
    lines = s.createDataFrame([("capacity_basis: per_lane",), ("length_unit: m  # metres",), ("vot: TODO",), ("capacity_period: daily",), ("# none",)], "value string")
    return checks.declarations(edits.declared(lines), checks.link_facts(links(s, sf)), 3.0)


# estimation, vehicles, simulation and map matching
from .operators import estimate  # noqa: E402


def count_pairs(s, sf):
    return loaded(s, sf)[1].withColumn("target", F.col("volume") + (F.col("o") * 7 + F.col("d")) % 5 - 2)


def counts(s, sf):
    return links(s, sf).select("link_id", F.when(F.col("link_id") % 3 == 0, F.col("volume")).otherwise(-1.0).alias("obs"))


_EST = FLOWS + """, od2 AS (SELECT mode, o, d, volume, volume + (o * 7 + d) % 5 - 2 AS target FROM t), tot AS (SELECT link_id, sum(steps.volume) AS v FROM steps GROUP BY link_id),
off AS (SELECT link.link_id, coalesce(v, 0) - link.volume AS off FROM link LEFT JOIN tot USING (link_id) WHERE link.link_id % 3 = 0 AND link.volume > 1)"""
register("odme_objective", lambda s, sf: estimate.objective(count_pairs(s, sf), counts(s, sf)), _EST + " SELECT (SELECT sum(pow(volume - target, 2)) FROM od2) AS od_term, (SELECT sum(off * off) FROM off) AS link_term, (SELECT sum(pow(volume - target, 2)) FROM od2) + (SELECT sum(off * off) FROM off) AS total")
register("odme_gradient", lambda s, sf: estimate.gradient(count_pairs(s, sf), counts(s, sf)), _EST + " SELECT mode, od2.o, od2.d, 2 * (any_value(od2.volume) - any_value(target)) + 2 * coalesce(sum(off), 0) AS gradient FROM od2 JOIN steps USING (mode, o, d) LEFT JOIN off USING (link_id) GROUP BY mode, od2.o, od2.d")
register("vehicle_generation", lambda s, sf: estimate.vehicles(loaded(s, sf)[1]).groupBy("mode", "o", "d").agg(F.count("*").alias("vehicles"), F.min("departure").alias("first"), F.max("departure").alias("last")), FLOWS + ", g AS (SELECT mode, o, d, volume AS n FROM t) SELECT mode, o, d, CAST(n AS BIGINT) AS vehicles, '07:00:00' AS first, printf('%02d:%02d:%02d', CAST(x // 3600 AS INT), CAST(x % 3600 // 60 AS INT), CAST(x % 60 AS INT)) AS last FROM (SELECT *, CAST(floor((420 + (n - 1) * 60e0 / n) * 60) AS BIGINT) AS x FROM g)")


def simulation(s, sf):
    """All reachable pairs with their own volumes; those that share roads are one task."""
    agents = estimate.vehicles(loaded(s, sf)[1]).withColumn("agent_id", F.xxhash64("mode", "o", "d", "i"))
    return estimate.simulate(links(s, sf), agents)


register("simulate", simulation)


def gps(s, sf):
    e = s.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("trace_no"), (F.col("event_id") * 37 % 401 / 100).alias("x"), (F.col("event_id") * 53 % 397 / 100).alias("y"))


def link_lines(s, sf):
    n = derived(s, sf, "node")
    a, b = n.select(F.col("node_id").alias("from_node_id"), F.col("x").alias("x1"), F.col("y").alias("y1")), n.select(F.col("node_id").alias("to_node_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return links(s, sf).join(F.broadcast(a), "from_node_id").join(F.broadcast(b), "to_node_id").select("link_id", "x1", "y1", "x2", "y2")


_GPS = ", gps AS (SELECT user_id AS agent_id, event_id AS trace_no, event_id * 37 % 401 / 100 AS x, event_id * 53 % 397 / 100 AS y FROM events)"
register("gps_cell_match", lambda s, sf: estimate.match_points(gps(s, sf), link_lines(s, sf)), with_ctes("node", "link") + _GPS + """, seg AS (SELECT link_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM link JOIN node a ON a.node_id = from_node_id JOIN node b ON b.node_id = to_node_id),
q AS (SELECT agent_id, trace_no, link_id, round(sqrt(pow(x - x1 - u * (x2 - x1), 2) + pow(y - y1 - u * (y2 - y1), 2)), 9) AS distance FROM (SELECT *, greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS u FROM gps, seg
  WHERE floor(x / 0.5e0) BETWEEN floor(least(x1, x2) / 0.5e0) - 1 AND floor(greatest(x1, x2) / 0.5e0) + 1 AND floor(y / 0.5e0) BETWEEN floor(least(y1, y2) / 0.5e0) - 1 AND floor(greatest(y1, y2) / 0.5e0) + 1))
SELECT agent_id, trace_no, (list(link_id ORDER BY distance, link_id))[1] AS link_id, min(distance) AS distance FROM q GROUP BY agent_id, trace_no""")
register("gps_od_zone", lambda s, sf: estimate.trace_ends(gps(s, sf), derived(s, sf, "node")), with_ctes("node") + _GPS + """, p AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY trace_no) AS a, row_number() OVER (PARTITION BY agent_id ORDER BY trace_no DESC) AS b FROM gps),
m AS (SELECT agent_id, avg(CASE WHEN a <= 3 THEN x END) AS ax, avg(CASE WHEN a <= 3 THEN y END) AS ay, avg(CASE WHEN b <= 3 THEN x END) AS bx, avg(CASE WHEN b <= 3 THEN y END) AS zy FROM p GROUP BY agent_id)
SELECT agent_id, (list(zone_id ORDER BY round((ax - x) * (ax - x) + (ay - y) * (ay - y), 9), zone_id))[1] AS o, (list(zone_id ORDER BY round((bx - x) * (bx - x) + (zy - y) * (zy - y), 9), zone_id))[1] AS d FROM m, node GROUP BY agent_id""")

# routes, zone hierarchies, intake and gates
from .operators import edits  # noqa: E402

SHARES = [0.5, 0.3, 0.2]


def merged_routes(s, sf):
    """Routes of three loadings, at free flow and with two sets of links made slower, merged by sequence."""
    v, demand, out = links(s, sf), derived(s, sf, "demand"), None
    for k, slow in enumerate((0, 7, 7)):
        net = v.withColumn("cost", F.col("cost") * F.when(F.lit(slow > 0) & (F.col("link_id") % 7 == 0), 3).otherwise(1))
        r = paths.load(net, demand, modes=False)[1].filter("links IS NOT NULL").withColumn("iteration", F.lit(k))
        out = r if out is None else out.unionByName(r)
    return edits.merge_routes(out, SHARES).groupBy("mode", "o", "d").agg(F.count("*").alias("routes"), F.round(F.sum("volume"), 4).alias("volume"), F.max("link_sum").alias("link_sum"))


_SLOW = "slow AS (SELECT link.* REPLACE (CASE WHEN link_id % 7 = 0 THEN cost * 3 ELSE cost END AS cost) FROM link)"
_T2 = _tree_sql(table="slow").split(", sp(o")[1].replace("sp s", "sp2 s").replace("recurring.sp", "recurring.sp2")
register("route_dedupe", merged_routes, FLOWS.replace(", sp(o, n, c, via)", f", {_SLOW}, sp2(o" + _T2 + ", sp(o, n, c, via)", 1) + """,
walk2(mode, o, d, volume, n) AS (SELECT mode, o, d, volume, d FROM t UNION ALL SELECT w.mode, w.o, w.d, w.volume, l.from_node_id FROM walk2 w JOIN sp2 ON sp2.o = w.o AND sp2.n = w.n JOIN link l ON l.link_id = sp2.via WHERE w.n <> w.o),
steps2 AS (SELECT w.mode, w.o, w.d, w.volume, sp2.via AS link_id FROM walk2 w JOIN sp2 ON sp2.o = w.o AND sp2.n = w.n WHERE w.n <> w.o),
r AS (SELECT mode, o, d, any_value(volume) AS volume, list(link_id ORDER BY link_id) AS k, sum(link_id) AS link_sum FROM steps GROUP BY mode, o, d UNION ALL SELECT mode, o, d, any_value(volume), list(link_id ORDER BY link_id), sum(link_id) FROM steps2 GROUP BY mode, o, d)
SELECT mode, o, d, count(DISTINCT k) AS routes, round(any_value(volume), 4) AS volume, CAST(max(link_sum) AS BIGINT) AS link_sum FROM r GROUP BY mode, o, d""")
register("theta_shares", lambda s, sf: s.createDataFrame([(i, float(x)) for i, x in enumerate(solver.Result(None, [], [0.5, 0.25, 0.125]).shares())], "iteration int, share double"), "SELECT * FROM (VALUES (CAST(0 AS INT), 0.328125e0), (1, 0.328125e0), (2, 0.21875e0), (3, 0.125e0)) v(iteration, share)")


def hierarchy_links(s, sf):
    n, v, d = edits.hierarchy(derived(s, sf, "node"), links(s, sf), derived(s, sf, "demand"), zone_map(s, sf))
    return v.select("link_id", "from_node_id", "to_node_id", "fftt").withColumn("fftt", F.round("fftt", 6))


register("superzone_hier_links", hierarchy_links, _GRID.replace(with_ctes("node", "demand"), with_ctes("node", "link", "demand")) + """, s AS (SELECT rep_id, row_number() OVER (ORDER BY rep_id) AS super FROM (SELECT DISTINCT rep_id FROM m)), z AS (SELECT zone_id, super, zone_id + (SELECT count(*) FROM s) AS new_id FROM m JOIN s USING (rep_id))
SELECT link_id, a.new_id AS from_node_id, b.new_id AS to_node_id, round(fftt, 6) AS fftt FROM link JOIN z a ON a.zone_id = from_node_id JOIN z b ON b.zone_id = to_node_id
UNION ALL SELECT 900000000 + super * 10000 + new_id, super, new_id, 0 FROM z UNION ALL SELECT 900000000 + new_id * 10000 + super, new_id, super, 0 FROM z""")


def repaired(s, sf):
    p = s.read.parquet(f"{sf}/part.parquet").withColumn("facility", F.element_at(F.array(*[F.lit(x) for x in ("motorway", "Trunk ", "primary", "other")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    lanes, capacity = edits.repair_capacity(F.col("p_size") % 4, F.col("p_size") % 3 * 700.0, F.col("facility"))
    return p.select("p_partkey", lanes.alias("lanes"), capacity.alias("capacity"))


register("adapt_repair", repaired, "SELECT p_partkey, CASE WHEN p_size % 4 <= 0 THEN 1 ELSE p_size % 4 END AS lanes, CASE WHEN p_size % 3 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN 2000e0 WHEN 1 THEN 1900e0 WHEN 2 THEN 1500e0 ELSE 1000e0 END ELSE p_size % 3 * 700e0 END AS capacity FROM part")
register("intake_evidence", lambda s, sf: edits.evidence(links(s, sf)), with_ctes("link") + " SELECT severity, code FROM (SELECT quantile_cont(length, 0.5) AS l, max(capacity) AS c, quantile_cont(volume / capacity / lanes, 0.5) AS vc, count(DISTINCT plf) AS p FROM link) a, (VALUES ('BLOCKER', 'length_in_metres'), ('BLOCKER', 'daily_capacity'), ('DECISION', 'empty_network'), ('DECISION', 'flat_plf')) f(severity, code) WHERE CASE code WHEN 'length_in_metres' THEN l > 100 WHEN 'daily_capacity' THEN c > 10000 WHEN 'empty_network' THEN vc < 0.05e0 ELSE p <= 1 END")
register("stage_gate", lambda s, sf: edits.worst_gate(QUERIES["r5_identities"](s, sf).select("gate").unionByName(QUERIES["r3_join_rate"](s, sf).select("gate")).unionByName(QUERIES["r6_gate"](s, sf).select("gate"))), "SELECT 'FAIL' AS gate")
register("intake_declarations", declared_query, "SELECT * FROM (VALUES " + ", ".join(f"('{sev}', 'submission', 'undeclared', '{k}')" for k, sev in checks.DECLARATIONS if k not in ("capacity_basis", "length_unit", "capacity_period")) + ", ('DECISION', 'submission', 'daily_capacity', 'capacity_period'), ('DECISION', 'submission', 'length_unit_differs', 'm'), ('DECISION', 'submission', 'flat_plf', 'peak_load_factor')) f(severity, file, code, item)")


def matrix_to_long(s, sf):
    d = derived(s, sf, "demand")
    wide = d.groupBy("o", F.col("mode").alias("core")).pivot("d", list(range(1, 26))).agg(F.sum("volume"))
    return edits.wide_to_long(wide, "o", {"AUTOMOBILE": "auto", "BUILDING": "auto", "MACHINERY": "truck"})


register("matrix_to_long", matrix_to_long, with_ctes("demand") + " SELECT CASE mode WHEN 'MACHINERY' THEN 'truck' ELSE 'auto' END AS mode, o, d, sum(volume) AS volume FROM demand WHERE mode IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') GROUP BY 1, o, d HAVING sum(volume) > 0")
register("system_cost", lambda s, sf: reports.with_time(links(s, sf).drop("volume").join(aon_volume(s, sf), "link_id")).agg(F.round(F.sum(F.col("travel_time") * F.col("volume")) / 1e6, 4).alias("total")), _AON + " SELECT round(sum(tt * volume) / 1e6, 4) AS total FROM p WHERE volume > 0")
register("kmeans_superzones", lambda s, sf: edits.zone_clusters(derived(s, sf, "node"), 6).groupBy("cluster").agg(F.count("*").alias("zones")))
register("od_rank_energy", lambda s, sf: edits.rank_energy(derived(s, sf, "demand")))
register("plf_apply", lambda s, sf: rounded(staging.with_plf(links(s, sf), "AM"), "link_id", plf="plf"), with_ctes("link") + " SELECT link_id, round(greatest(least(CASE WHEN link_type IN (2, 3, 4, 6, 10, 11) THEN 2.48e0 ELSE 2.83e0 END / 3e0, 1e0), 1e0 / 3e0), 6) AS plf FROM link")


def own_links(s, sf):
    """Links with parameters of their own."""
    k = F.col("link_id")
    return links(s, sf).withColumns({"linear": k % 3 * 0.1, "conic_a": F.when(k % 2 == 0, 4.0).otherwise(0.0), "conic_b": F.lit(0.0), "cutoff": F.col("free_speed") * 0.6, "cd": 1 + k % 3 * 0.1, "n": 1 + k % 2 * 0.2, "green": 0.3 + k % 3 * 0.1})


_OWN = LOADED.replace("0.75e0 * free_speed AS vc", "0.6e0 * free_speed AS vc") + f""", o AS (SELECT *, link_id % 3 * 0.1e0 AS li, CASE WHEN link_id % 2 = 0 THEN 4e0 ELSE alpha END AS ca, CASE WHEN link_id % 2 = 0 THEN 7e0 / 6 ELSE beta END AS cb, (1 + link_id % 3 * 0.1e0) * pow(x, 1 + link_id % 2 * 0.2e0) AS pp, 0.3e0 + link_id % 3 * 0.1e0 AS gr, {REF} AS ref FROM v),
q AS (SELECT *, ref / (1 + alpha * pow(x, beta)) AS qs FROM o), z AS (SELECT link_id, CASE vdf_type WHEN 0 THEN fftt * (1 + li * x + alpha * pow(x, beta)) WHEN 1 THEN fftt * (2 + sqrt(ca * ca * (1 - x) * (1 - x) + cb * cb) - ca * (1 - x) - cb)
  WHEN 2 THEN length / greatest(0.1e0, CASE WHEN pp > 1 THEN qs ELSE pp * qs + (1 - pp) * (ref + free_speed) / 2 END) * 60 WHEN 3 THEN {FORMULAS['bpr2'][1]} WHEN 4 THEN {FORMULAS['inrets'][1]} WHEN 5 THEN {FORMULAS['akcelik'][1]}
  ELSE {BPR} + 30 * pow(1 - gr, 2) / greatest(0.05e0, 1 - least(1e0, x) * gr) / 60 END AS tt FROM q)"""
register("link_times_own_parameters", lambda s, sf: rounded(reports.with_time(own_links(s, sf)), "link_id", digits=5, travel_time="travel_time"), _OWN + " SELECT link_id, round(greatest(0e0, tt), 5) AS travel_time FROM z")

# reports of pairs
register("od_report", lambda s, sf: rounded(edits.od_report(minutes_pairs(s, sf), derived(s, sf, "node"), 25), "mode", "o", "d", "geometry", "map_url", digits=5, miles="miles", minutes="minutes", straight_miles="straight_miles", ratio="ratio"), _PAIRS + """, a AS (SELECT p.*, m.x AS x1, m.y AS y1, n.x AS x2, n.y AS y2, pow(sin(radians(n.y - m.y) / 2), 2) + cos(radians(m.y)) * cos(radians(n.y)) * pow(sin(radians(n.x - m.x) / 2), 2) AS h FROM pairs p JOIN node m ON m.node_id = p.o JOIN node n ON n.node_id = p.d),
b AS (SELECT *, 3958.8e0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS s FROM a)
SELECT mode, o, d, printf('LINESTRING (%.6f %.6f, %.6f %.6f)', x1::DOUBLE, y1::DOUBLE, x2::DOUBLE, y2::DOUBLE) AS geometry, CASE WHEN volume > 10 THEN printf('https://www.google.com/maps/dir/%.6f,%.6f/%.6f,%.6f', y1::DOUBLE, x1::DOUBLE, y2::DOUBLE, x2::DOUBLE) ELSE '' END AS map_url,
  round(miles, 5) AS miles, round(cost, 5) AS minutes, round(s, 5) AS straight_miles, round(CASE WHEN s < 0.001e0 THEN 1 ELSE miles / s END, 5) AS ratio FROM b""")
register("path_totals", lambda s, sf: rounded(reports.totals(minutes_pairs(s, sf), lengths(s, sf)), "pairs", "trips", digits=4, pair_miles="pair_miles", pair_minutes="pair_minutes", trip_miles="trip_miles", trip_minutes="trip_minutes"), _PAIRS + " SELECT count(*) AS pairs, sum(volume) AS trips, round(avg(miles), 4) AS pair_miles, round(avg(cost), 4) AS pair_minutes, round(sum(volume * miles) / sum(volume), 4) AS trip_miles, round(sum(volume * cost) / sum(volume), 4) AS trip_minutes FROM pairs")
register("delay_performance", lambda s, sf: rounded(reports.delay_performance(minutes_pairs(s, sf).withColumn("cost", F.col("cost") * (1 + F.col("o") / 50)), lengths(s, sf), minutes_pairs(s, sf).select("mode", "o", "d", F.col("cost").alias("free_minutes"))), "mode", digits=4, hours="hours", free_hours="free_hours", delay="delay", tti="tti", speed="speed", free_speed="free_speed"), _PAIRS + ", a AS (SELECT mode, sum(volume * cost * (1 + o / 50) / 60) AS h, sum(volume * cost / 60) AS f, sum(volume * miles) AS m FROM pairs GROUP BY mode) SELECT mode, round(h, 4) AS hours, round(f, 4) AS free_hours, round(h - f, 4) AS delay, round(h / f, 4) AS tti, round(m / h, 4) AS speed, round(m / f, 4) AS free_speed FROM a")
register("access_reasons", lambda s, sf: checks.access(cut_network(s, sf), derived(s, sf, "mode").withColumn("mode", F.col("mode")), derived(s, sf, "demand"), paths.load_pairs(cut_network(s, sf).withColumn("allowed_use", F.lit("all")), derived(s, sf, "demand"))).select("mode", "kind", "o", "d", "volume"),
         _tree_sql("AND l.from_node_id <> 13 AND l.to_node_id <> 25").replace(with_ctes("link", recursive=True), with_ctes("link", "demand", "mode", recursive=True)) + f", cut AS (SELECT * FROM link WHERE from_node_id <> 13 AND to_node_id <> 25) SELECT d.mode, CASE WHEN NOT EXISTS (SELECT 1 FROM cut JOIN mode m ON {_CAN.replace('mode)', 'm.mode)')} WHERE m.mode = d.mode AND from_node_id = d.o) THEN 'no_out' WHEN NOT EXISTS (SELECT 1 FROM cut JOIN mode m ON {_CAN.replace('mode)', 'm.mode)')} WHERE m.mode = d.mode AND to_node_id = d.d) THEN 'no_in' ELSE 'no_path' END AS kind, d.o, d.d, volume FROM demand d WHERE volume > 1e-6 AND d.o <> d.d AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.o = d.o AND sp.n = d.d)")
register("two_skims", lambda s, sf: rounded(compare.two_skims(minutes_skim(s, sf, links(s, sf)), minutes_skim(s, sf, links(s, sf).withColumn("cost", F.col("cost") * F.when(F.col("link_id") % 7 == 0, 3).otherwise(1)))), "pairs", digits=5, r2="r2", mean_difference="mean_difference"),
         FLOWS.split(", t AS (SELECT mode")[0].replace(", sp(o, n, c, via)", f", {_SLOW}, sp2(o" + _T2 + ", sp(o, n, c, via)", 1) + " SELECT count(*) AS pairs, round(1 - sum(pow((sp.c - sp2.c) / 1e7, 2)) / (var_pop(sp.c / 1e7) * count(*)), 5) AS r2, round(avg(abs(sp.c - sp2.c) / 1e7), 5) AS mean_difference FROM sp JOIN sp2 USING (o, n)")


def minutes_skim(s, sf, v):
    return paths.skim(v, origins(s, sf)).withColumn("cost", F.col("cost") / 1e7)


register("skim_of_pairs", lambda s, sf: paths.skim(links(s, sf).withColumn("cost", F.col("cost") / 1e7), origins(s, sf), floor=2.0, pairs=derived(s, sf, "demand").filter("volume > 0"), digits=4),
         _tree_sql(table="timed").replace("CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM node", "CAST(0 AS DOUBLE), CAST(0 AS BIGINT) FROM node").replace(with_ctes("link", recursive=True), with_ctes("link", "demand", recursive=True) + ", timed AS (SELECT link.* REPLACE (greatest(cost / 1e7, 2e0) AS cost) FROM link)") + " SELECT o, n AS d, round(c, 4) AS cost FROM sp WHERE EXISTS (SELECT 1 FROM demand x WHERE x.o = sp.o AND x.d = sp.n AND volume > 0)")


def vmt_objective(s, sf):
    return estimate.objective(count_pairs(s, sf), counts(s, sf), w_vmt=1e-3, vmt=100_000.0)


register("odme_vmt_objective", lambda s, sf: rounded(vmt_objective(s, sf), "od_term", "link_term", digits=3, vmt_term="vmt_term", total="total"), _EST + ", m AS (SELECT pow(sum(steps.volume * length) - 100000, 2) AS m FROM steps JOIN link USING (link_id)) SELECT (SELECT sum(pow(volume - target, 2)) FROM od2) AS od_term, (SELECT sum(off * off) FROM off) AS link_term, round(m, 3) AS vmt_term, round((SELECT sum(pow(volume - target, 2)) FROM od2) + (SELECT sum(off * off) FROM off) + 1e-3 * m, 3) AS total FROM m")
register("count_fit", lambda s, sf: rounded(compare.fit_of_counts(links(s, sf).join(counts(s, sf), "link_id").withColumn("volume", F.col("ref_volume"))), "n", "sum_volume", "sum_obs", digits=5, r2="r2", correlation2="correlation2", rmse="rmse"), with_ctes("link") + " SELECT count(*) AS n, sum(ref_volume) AS sum_volume, sum(volume) AS sum_obs, round(1 - sum(pow(ref_volume - volume, 2)) / (var_pop(volume) * count(*)), 5) AS r2, round(pow(corr(ref_volume, volume), 2), 5) AS correlation2, round(sqrt(avg(pow(ref_volume - volume, 2))), 5) AS rmse FROM link WHERE link_id % 3 = 0 AND volume > 1")
register("odme_estimate", lambda s, sf: estimate.estimate(count_pairs(s, sf).select("mode", "o", "d", "volume", "target", "links"), counts(s, sf), 2).groupBy("mode").agg(F.count("*").alias("pairs"), F.round(F.sum("volume"), 2).alias("volume")))


def routes_of_three(s, sf):
    v, demand, out = links(s, sf), derived(s, sf, "demand"), None
    for k, slow in enumerate((0, 7, 11)):
        net = v.withColumn("cost", F.col("cost") * F.when(F.lit(slow > 0) & (F.col("link_id") % max(slow, 2) == 0), 3).otherwise(1))
        r = paths.load_pairs(net, demand, modes=False).filter("links IS NOT NULL").withColumn("iteration", F.lit(k))
        out = r if out is None else out.unionByName(r)
    return edits.merge_routes(out, SHARES)


register("route_table", lambda s, sf: edits.numbered_routes(routes_of_three(s, sf), 25)[0].select("mode", "o", "d", "route_id", F.round("share", 6).alias("share"), reports.joined_ids(F.col("links")).alias("links")))
register("mode_split_pairs", lambda s, sf: derived(s, sf, "demand").groupBy("o", "d").agg(F.countDistinct("mode").alias("classes")), with_ctes("demand") + " SELECT o, d, count(DISTINCT mode) AS classes FROM demand GROUP BY o, d")
register("pattern_clusters", lambda s, sf: edits.pattern_clusters(derived(s, sf, "demand"), 5, 6).groupBy("cluster").agg(F.count("*").alias("zones")))
register("weighted_clusters", lambda s, sf: edits.zone_clusters(edits.demand_weights(derived(s, sf, "node"), derived(s, sf, "demand")), 6, "weight").groupBy("cluster").agg(F.count("*").alias("zones")))
register("gps_routes", lambda s, sf: estimate.trace_routes(estimate.trace_ends(gps(s, sf), derived(s, sf, "node")), links(s, sf), "cost").select("agent_id", "o", "d", F.col("cost").cast("long").alias("cost")),
         _tree_sql().replace(with_ctes("link", recursive=True), with_ctes("link", recursive=True) + _GPS) + ORACLES["gps_od_zone"][len(with_ctes("node") + _GPS):].replace("\nSELECT agent_id", "\n, z AS (SELECT agent_id") + ") SELECT agent_id, z.o, z.d, CASE WHEN z.o <> z.d THEN c END AS cost FROM z LEFT JOIN sp ON sp.o = z.o AND sp.n = z.d")
register("trajectories", lambda s, sf: estimate.simulate(links(s, sf), estimate.vehicles(loaded(s, sf)[1]).withColumn("agent_id", F.xxhash64("mode", "o", "d", "i")), trajectory=True).groupBy("place").agg(F.count("*").alias("entries")))

# a network that grows with the tables
_GTREE = _tree_sql(table="glink").replace(with_ctes("link", recursive=True), with_ctes("glink", "gdemand", recursive=True)).replace("FROM node", "FROM gnode")
_GFLOWS = _GTREE + """, t AS (SELECT mode, o, d, volume FROM gdemand WHERE volume > 0 AND o <> d),
walk(mode, o, d, volume, n) AS (SELECT mode, o, d, volume, d FROM t UNION ALL SELECT w.mode, w.o, w.d, w.volume, l.from_node_id FROM walk w JOIN sp ON sp.o = w.o AND sp.n = w.n JOIN glink l ON l.link_id = sp.via WHERE w.n <> w.o),
steps AS (SELECT w.mode, w.o, w.d, w.volume, sp.via AS link_id FROM walk w JOIN sp ON sp.o = w.o AND sp.n = w.n WHERE w.n <> w.o)"""


def network(s, sf):
    return derived(s, sf, "glink"), derived(s, sf, "gdemand")


register("network_skim", lambda s, sf: paths.skim(network(s, sf)[0], derived(s, sf, "gnode").select(F.col("node_id").alias("o"))), _GTREE + " SELECT o, n AS d, c AS cost FROM sp")
register("network_flows", lambda s, sf: paths.load_flows(*network(s, sf)), _GFLOWS + " SELECT mode, link_id, sum(volume) AS flow FROM steps GROUP BY mode, link_id")
register("network_od_performance", lambda s, sf: paths.load_pairs(*network(s, sf), routes=False).select("mode", "o", "d", "volume", F.col("cost").cast("long").alias("cost"), F.round("miles", 6).alias("miles"), "hops"), _GFLOWS + " SELECT mode, steps.o, steps.d, any_value(steps.volume) AS volume, any_value(sp.c) AS cost, round(sum(length), 6) AS miles, count(*) AS hops FROM steps JOIN glink USING (link_id) JOIN sp ON sp.o = steps.o AND sp.n = steps.d GROUP BY mode, steps.o, steps.d")


def network_equilibrium(s, sf):
    r = solver.assign(*network(s, sf), derived(s, sf, "mode"), solver.Settings(iterations=6, hours=8.0))
    return s.createDataFrame([(i + 1, float(g), float(a)) for i, (g, a) in enumerate(zip(r.gaps, r.steps, strict=True))], "iteration int, gap_percent double, step double")


register("network_equilibrium", network_equilibrium)
