"""Delay parameters by facility, peak load factors, and other layouts brought into ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import canonical_names, repair_capacity
from .reports import bound_plf

# Conic a by facility type.
CONIC_A = {1: 15.0, 2: 7.0, 3: 5.5, 4: 3.0, 5: 8.0, 6: 15.0}
PLF_DEFAULT, PLF_RANGE = 0.8503, (0.3, 1.5)
# Queue parameters (alpha, beta, cp, cd, n, s, plf) by facility type, and those of all others.
QUEUE = {1: (0.1632, 4.5725, 0.1602, 0.9897, 1.1941, 4.0, 0.7379), 2: (0.2068, 4.1252, 0.1248, 1.0134, 1.2158, 4.0, 0.5650), 5: (0.1311, 4.6887, 0.1692, 1.0, 1.2102, 4.0, 0.6803)}
QUEUE_OTHERS = (0.1762, 4.4204, 0.1482, 0.9993, 1.2035, 4.0, 0.6552)
# Fixed values: (linear, alpha, beta) by facility type; weaving links; types that weave; use by prohibition code.
MODIFIED = {1: (0.1, 0.6, 6.0), 4: (0.1, 0.6, 6.0), 5: (0.1, 0.6, 6.0), 6: (0.1, 0.6, 6.0), 2: (0.0, 1.0, 4.0), 3: (0.0, 1.25, 4.0), 7: (0.1, 1.0, 4.0), 8: (0.1, 1.0, 4.0), 9: (0.1, 1.0, 4.0), 0: (0.0, 0.15, 4.0)}
MODIFIED_OTHERS, WEAVE = (0.1, 0.45, 4.0), (0.2, 1.25, 5.5)
WEAVING_TYPES = (1, 4, 5, 6)
PROHIBITED_USE = {2: "hov2;hov3", 11: "hov2;hov3", 6: "hov3", 4: "trk", 10: "trk"}
# Hour-to-period factors by period and facility type (others: the last), and hours of the periods.
PERIOD_FACTORS = {"AM": (2.83, 2.48), "MD": (4.79, 4.64), "PM": (3.90, 3.63), "NT": (4.80, 4.68)}
PEAKED_TYPES = (2, 3, 4, 6, 10, 11)
PERIOD_HOURS = {"AM": 3.0, "MD": 5.0, "PM": 4.0, "NT": 12.0}
UNIFORM_FACTORS = {"EA": (1.25, 3.0), "AM": (3.66, 4.0), "MD": (4.70, 5.0), "PM": (3.66, 4.0), "EV": (3.91, 8.0)}
# Load factors by period: of all types, of major arterials.
LOAD_FACTORS = {"AM": (0.94, 0.83), "MD": (0.96, 0.93), "PM": (0.98, 0.91), "NT": (0.40, 0.39)}
# Fixed values: (free speed, alpha, beta) by code, area type times 100 plus facility type; connectors (x05) have none.
BY_CODE = {
    100: (70, 0.74, 4.60), 101: (70, 0.99, 3.50), 102: (47, 5, 2.00), 103: (25, 1.8, 1.90), 104: (37, 3.9, 1.50), 106: (35, 1.8, 1.90), 107: (39, 1.8, 1.90), 108: (30, 1.8, 1.90), 109: (50, 0.87, 5.00), 110: (47, 1.8, 1.90), 111: (15, 1.8, 1.90),
    200: (70, 1.88, 3.10), 201: (70, 0.99, 3.50), 202: (49, 5, 2.00), 203: (28, 1.8, 1.90), 204: (39, 8, 2.00), 206: (40, 1.8, 1.90), 207: (40, 1.8, 1.90), 208: (30, 1.8, 1.90), 209: (53, 0.75, 4.00), 210: (49, 1.8, 1.90), 211: (20, 1.8, 1.90),
    300: (75, 1.88, 3.10), 301: (71, 0.99, 3.50), 302: (55, 5, 2.00), 303: (37, 2.6, 2.00), 304: (41, 3.2, 2.50), 306: (41, 2.6, 2.00), 307: (44, 2.6, 2.00), 308: (30, 2.6, 2.00), 309: (57, 0.71, 3.47), 310: (55, 2.6, 2.00), 311: (25, 2.6, 2.00),
    400: (75, 1.88, 3.10), 401: (71, 4, 6), 402: (55, 20, 2.50), 403: (39, 3.6, 2.50), 404: (42, 3.2, 2.50), 406: (41, 3.6, 2.50), 407: (44, 3.6, 2.50), 408: (30, 3.6, 2.50), 409: (59, 0.71, 3.47), 410: (55, 3.6, 2.50), 411: (25, 3.6, 2.50),
    500: (75, 1.88, 3.10), 501: (72, 400, 6), 502: (57, 20, 2.50), 503: (40, 3.6, 2.50), 504: (43, 3.6, 2.50), 506: (42, 3.6, 2.50), 507: (46, 3.6, 2.50), 508: (30, 3.6, 2.50), 509: (61, 0.71, 3.47), 510: (57, 3.6, 2.50), 511: (30, 3.6, 2.50),
}


def lookup(key: Column, table: dict, place: int | None = None) -> Column:
    """The table's value of key (its ``place``-th part), null where it has none."""
    parts = [F.lit(x) for k, v in table.items() for x in (k, float(v if place is None else v[place]) if not isinstance(v, str) else v)]
    return F.try_element_at(F.create_map(*parts), key.cast("int"))


def with_conic(links: DataFrame, facility: str = "facility") -> DataFrame:
    """Conic delay with a by facility type and b from a; other types get plain BPR."""
    a = lookup(F.col(facility), CONIC_A)
    return links.withColumns({"vdf_type": F.when(a.isNotNull(), 1).otherwise(0), "conic_a": F.coalesce(a, F.lit(0.0)), "conic_b": F.coalesce((2 * a - 1) / (2 * a - 2), F.lit(0.0))})


def observed_plf(volume: Column, hourly_capacity: Column, ratio: Column, hours: float = 4.0) -> Column:
    """The peak load factor that a period volume, an hourly capacity and a V/C imply; the default where that is out of range."""
    plf = volume / (hours * hourly_capacity * ratio)
    fine = (volume > 0) & (hourly_capacity > 0) & (ratio > 0)
    return F.when(fine & (plf >= PLF_RANGE[0]) & (plf <= PLF_RANGE[1]), plf).otherwise(F.lit(PLF_DEFAULT))


def with_queue(links: DataFrame, facility: str = "facility") -> DataFrame:
    """Queue-based delay by facility type, the others' parameters where a type has none; type 0 stays BPR as it is."""
    c = F.col(facility)
    names = ("alpha", "beta", "cp", "cd", "n", "s", "plf")
    own = {n: F.coalesce(lookup(c, QUEUE, i), F.lit(QUEUE_OTHERS[i])) for i, n in enumerate(names)}
    keep = {n: F.when(c == 0, F.col(n) if n in links.columns else F.lit(None)).otherwise(v) for n, v in own.items()}
    return links.withColumns({"vdf_type": F.when(c == 0, 0).otherwise(2), **keep})


def with_modified_bpr(links: DataFrame, facility: str = "facility", weave: str = "weave") -> DataFrame:
    """linear, alpha, beta by facility type, those of weaving where the link weaves; capacity of wide weaving links reduced."""
    c, w = F.col(facility), F.coalesce(F.col(weave) == 1, F.lit(False))
    turn = w & c.isin(*WEAVING_TYPES)
    pick = lambda i: F.when(turn, F.lit(WEAVE[i])).otherwise(F.coalesce(lookup(c, MODIFIED, i), F.lit(MODIFIED_OTHERS[i])))
    return links.withColumns({"linear": pick(0), "alpha": pick(1), "beta": pick(2), "capacity": F.when(w & (F.col("lanes") > 4), F.col("capacity") * F.pow(F.lit(0.98), F.col("lanes") - 1)).otherwise(F.col("capacity"))})


def prohibited_use(code: Column) -> Column:
    return F.coalesce(lookup(code, PROHIBITED_USE), F.lit(""))


def with_code_table(links: DataFrame, code: str = "vdf_code") -> DataFrame:
    """Free speed, alpha and beta of the calibrated codes; links of other codes and connectors stay as they are."""
    known = lookup(F.col(code), BY_CODE, 1)
    return links.withColumns({n: F.coalesce(lookup(F.col(code), BY_CODE, i), F.col(n)) for i, n in enumerate(("free_speed", "alpha", "beta"))}).withColumn("recoded", known.isNotNull())


def phi(plf: Column, hours: float) -> Column:
    """The hour-to-period factor that a peak load factor stands for."""
    return plf * hours


def plf_of_facility(facility: Column, period: str) -> Column:
    """Bounded peak load factor of a facility type in a period: its factor over the period's hours."""
    flat, peaked = PERIOD_FACTORS[period]
    return bound_plf(F.when(facility.isin(*PEAKED_TYPES), F.lit(peaked)).otherwise(F.lit(flat)) / PERIOD_HOURS[period], PERIOD_HOURS[period])


def uniform_plf(period: str) -> float:
    factor, hours = UNIFORM_FACTORS[period]
    return factor / hours


def with_plf(links: DataFrame, period: str, facility: str = "link_type") -> DataFrame:
    return links.withColumn("plf", plf_of_facility(F.col(facility), period))


def plf_inventory(links: DataFrame, hours: float, *by: str) -> DataFrame:
    """Per group: links, mean, least and greatest factor, phi of the mean, how many are flat, out of (0, 1], or below 1 / hours."""
    p = F.col("plf")
    return links.groupBy(*by).agg(F.count("*").alias("links"), F.avg(p).alias("mean_plf"), F.min(p).alias("min_plf"), F.max(p).alias("max_plf"), (F.avg(p) * hours).alias("phi"), F.sum((p == 1).cast("long")).alias("flat"), F.sum(((p <= 0) | (p > 1)).cast("long")).alias("out_of_range"), F.sum((p * hours < 1).cast("long")).alias("below_hour"))


def adapt_links(table: DataFrame, free_speed_unit: str = "mph", length_unit: str = "mi", code_table: bool = False) -> DataFrame:
    """A link table with any column spelling: canonical names, explicit unit columns, repaired lanes and capacity, in order."""
    t = canonical_names(table)
    text = lambda n: F.col(n) if n in t.columns else F.lit(None).cast("string")
    given = lambda n, other, use: F.coalesce(F.nullif(F.trim(text(n).cast("string")), F.lit("")), text(other).cast("string") if use else F.lit(None))
    t = t.withColumns({"vdf_free_speed_mph": given("vdf_free_speed_mph", "free_speed", free_speed_unit == "mph"), "vdf_length_mi": given("vdf_length_mi", "length", length_unit == "mi")})
    value = lambda n: F.coalesce(text(n).try_cast("double"), F.lit(0.0))
    lanes, capacity = repair_capacity(value("lanes"), value("capacity"), F.coalesce(text("facility_type").cast("string"), F.lit("")))
    t = t.withColumns({"lanes": lanes, "capacity": capacity})
    if code_table and "vdf_code" in t.columns:
        known = lookup(F.col("vdf_code").try_cast("double"), BY_CODE, 0)
        for i, names in enumerate((("vdf_free_speed_mph", "free_speed"), ("vdf_alpha",), ("vdf_beta",))):
            for n in names:
                t = t.withColumn(n, F.when(known.isNotNull(), lookup(F.col("vdf_code").try_cast("double"), BY_CODE, i).cast("string")).otherwise(text(n).cast("string")))
    return t.orderBy(F.col("from_node_id").try_cast("long"), F.col("to_node_id").try_cast("long"))


def period_of(text: str) -> tuple[float, float]:
    """(start, end) in hours of ``0600_0900``; an end not after its start is on the next day."""
    start, end = (int(p[:2]) + int(p[2:]) / 60 for p in text.split("_"))
    return start, end if end > start else end + 24


def single_period(table: DataFrame, nodes: DataFrame, settings: dict, period: str) -> tuple[DataFrame, dict]:
    """(links of one period of a table with period-numbered columns, what was chosen).

    Length from free-flow time and speed, hourly lane capacity from the period's, load factor by class,
    links in the order of their nodes in the node file. nodes: node_id, pos.
    """
    number_, hours = "1", (6.0, 9.0)
    for k, v in settings["periods"].items():
        if v["name"].upper() == period.upper():
            number_, hours = k, period_of(v["time_period"])
    long = hours[1] - hours[0]
    lower = {c.lower(): c for c in table.columns}
    get = lambda n: F.col(f"`{lower[n.lower()]}`").try_cast("double") if n.lower() in lower else F.lit(None).cast("double")
    keep = lambda n: F.col(f"`{lower[n.lower()]}`") if n.lower() in lower else F.lit(None).cast("string")
    lanes = F.when(F.coalesce(get("lanes"), F.lit(0.0)) == 0, 1.0).otherwise(get("lanes"))
    time, speed, cap = get(f"VDF_fftt{number_}"), F.coalesce(get("free_speed"), F.lit(0.0)), get(f"VDF_cap{number_}")
    flat, peaked = (bound_plf(F.lit(x), long) for x in LOAD_FACTORS.get(period.upper(), (1.0, 1.0)))
    out = table.select(
        keep("link_id").alias("link_id"), keep("from_node_id").try_cast("long").alias("from_node_id"), keep("to_node_id").try_cast("long").alias("to_node_id"), keep("link_type").alias("link_type"), lanes.alias("lanes"),
        F.when(F.coalesce(cap, F.lit(0.0)) != 0, F.round(cap / (lanes * long), 3)).otherwise(1000.0).alias("capacity"), speed.alias("vdf_free_speed_mph"),
        F.round(F.when((time != 0) & (speed != 0), time * speed / 60).otherwise(get("length")), 6).alias("vdf_length_mi"), F.lit(0).alias("vdf_type"),
        get(f"VDF_alpha{number_}").alias("vdf_alpha"), get(f"VDF_beta{number_}").alias("vdf_beta"), F.when(keep("link_type") == "2", peaked).otherwise(flat).alias("vdf_plf"), time.alias("vdf_fftt"),
        F.when(speed != 0, F.round(speed * 0.75, 3)).alias("cutoff_speed"), F.coalesce(keep(f"VDF_allowed_uses{number_}"), F.lit("")).alias("allowed_use"),
    )
    place = lambda n, end: nodes.select(F.col("node_id").alias(end), F.col("pos").alias(n))
    out = out.join(place("_a", "from_node_id"), "from_node_id", "left").join(place("_b", "to_node_id"), "to_node_id", "left").orderBy(F.col("_a").asc_nulls_last(), F.col("_b").asc_nulls_last()).drop("_a", "_b")
    return out, {"period": period.upper(), "number": number_, "start": hours[0], "end": hours[1], "demand_files": [d for d in settings["demand_files"] if d["period"].upper() == period.upper()]}


def conversion_log(spark, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """place, kind, field, value, note of the steps of a conversion (STEP, NOTE, INPUT, OUTPUT, WARN, MAP or ASSUME)."""
    kinds = ("STEP", "NOTE", "INPUT", "OUTPUT", "WARN", "MAP", "ASSUME")
    if bad := [e for e in entries if e[0] not in kinds]:
        raise ValueError(f"not a kind of entry: {bad[0][0]}")
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries, 1)], "place int, kind string, field string, value string, note string")
