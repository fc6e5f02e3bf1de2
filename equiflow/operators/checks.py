"""Checks of a scenario: findings, defaults, access, declarations. A finding is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.gmns import number, whole
from .reports import LINK_DEFAULTS, allowed, fill_defaults

FINDING = "severity string, file string, code string, item string"
# Columns that a file must have, and those that a queue-based link should have.
REQUIRED = {"node": ("node_id", "x_coord", "y_coord"), "link": ("from_node_id", "to_node_id", "lanes", "capacity", "free_speed"), "demand": ("o_zone_id", "d_zone_id", "volume")}
QUEUE_COLUMNS = ("vdf_cp", "vdf_cd", "vdf_n", "vdf_s")
# What a submission declares (key, severity where it doesn't).
DECLARATIONS = (
    ("capacity_basis", "BLOCKER"), ("capacity_period", "BLOCKER"), ("capacity_source_field", "MISSING"), ("peak_load_factor", "DECISION"),
    ("length_unit", "BLOCKER"), ("speed_unit", "DECISION"), ("demand_kind", "DECISION"), ("demand_period_hours", "DECISION"),
    ("zone_id_basis", "MISSING"), ("vot", "DECISION"), ("vdf_source", "MISSING"), ("count_field", "MISSING"),
)
SEVERITIES = ("BLOCKER", "DECISION", "MISSING", "INFO")


def finding(df: DataFrame, severity: str, file: str, code: str, item: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(file).alias("file"), F.lit(code).alias("code"), item.cast("string").alias("item"))


def fixed(spark, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, FINDING)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_tables(node: DataFrame, link: DataFrame, tokens: list[str] | None = None, hours: float | None = None) -> DataFrame:
    """Findings in node and link tables as they are in the files (all text, see ``gmns.table``).

    Missing columns, values that are no numbers or not above 0, unknown ends, repeated ids, links out of
    order (each place where the from node falls, in file order), queue links without their parameters,
    unknown class names, and a flat peak load factor over several hours.
    """
    spark = node.sparkSession
    parts = [fixed(spark, [("ERROR", f, "missing_column", c) for f, t in (("node", node), ("link", link)) for c in REQUIRED[f] if c not in t.columns])]
    for f, t in (("node", node), ("link", link)):
        if t.isEmpty():
            parts.append(fixed(spark, [("ERROR", f, "empty", f)]))
    if "link_id" not in link.columns:
        parts.append(fixed(spark, [("WARNING", "link", "no_link_id", "link_id")]))
    if "node_id" in node.columns:
        parts += [
            finding(node.filter(number(F.col("node_id")).isNull()), "ERROR", "node", "not_a_number", F.col("node_id")),
            finding(node.groupBy(whole(F.col("node_id")).alias("n")).count().filter("n IS NOT NULL AND count > 1"), "ERROR", "node", "duplicate_node", F.col("n")),
        ]
    ends = [c for c in ("from_node_id", "to_node_id") if c in link.columns]
    rows = link.withColumn("_at", F.monotonically_increasing_id())
    name = F.coalesce(F.col("link_id"), F.lit("")) if "link_id" in link.columns else F.concat_ws("-", *ends)
    known = node.select(whole(F.col("node_id")).alias("n")).distinct() if "node_id" in node.columns else None
    for c in ends:
        parts.append(finding(rows.filter(number(F.col(c)).isNull()), "ERROR", "link", "not_a_number", F.concat_ws(":", F.lit(c), name)))
        if known is not None:
            parts.append(finding(rows.filter(whole(F.col(c)).isNotNull()).join(known, whole(F.col(c)) == F.col("n"), "left_anti"), "ERROR", "link", f"unknown_{c[: c.index('_')]}", name))
    if "from_node_id" in ends:
        before = F.max(whole(F.col("from_node_id"))).over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))  # links, not trips
        parts.append(finding(rows.withColumn("_before", before).filter(whole(F.col("from_node_id")) < F.col("_before")).limit(1), "WARNING", "link", "not_sorted", name))
    for c in ("lanes", "capacity", "free_speed"):
        if c in link.columns:
            parts.append(finding(rows.filter(number(F.col(c)).isNull() | (number(F.col(c)) <= 0)), "ERROR", "link", "not_positive", F.concat_ws(":", F.lit(c), name)))
    if "link_id" in link.columns:
        parts.append(finding(link.groupBy(whole(F.col("link_id")).alias("n")).count().filter("n IS NOT NULL AND count > 1"), "ERROR", "link", "duplicate_link", F.col("n")))
    if "vdf_type" in link.columns:
        queue = rows.filter(F.trim("vdf_type") == "2")
        for c in QUEUE_COLUMNS:
            lacks = queue if c not in link.columns else queue.filter(number(F.col(c)).isNull())
            parts.append(finding(lacks, "WARNING", "link", "queue_parameter", F.concat_ws(":", F.lit(c), name)))
    if tokens and "allowed_use" in link.columns:
        use = F.lower(F.trim(F.coalesce("allowed_use", F.lit(""))))
        each = rows.filter(~use.isin("", "all", "closed")).select(name.alias("_n"), F.explode(F.split("allowed_use", "[;,]")).alias("_t")).filter(F.col("_t") != "")
        parts.append(finding(each.filter(~F.col("_t").isin(*tokens)), "WARNING", "link", "unknown_mode", F.concat_ws(":", "_n", "_t")))
    if hours and hours > 1:
        plf = next((c for c in link.columns if c.lower() == "vdf_plf"), None)
        values = link.agg(F.min(F.coalesce(number(F.col(plf)), F.lit(1.0))).alias("lo"), F.max(F.coalesce(number(F.col(plf)), F.lit(1.0))).alias("hi")) if plf else fixed(spark, []).agg(F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"))
        parts.append(finding(values.filter("round(lo, 4) = 1 AND round(hi, 4) = 1"), "WARNING", "link", "flat_plf", F.lit("vdf_plf")))
    return union(parts)


def check_demand(demand: DataFrame, node: DataFrame, file: str = "demand") -> DataFrame:
    """Findings in a demand table as it is in the file: missing columns, negative volumes, and how many ends are unknown."""
    missing = [c for c in REQUIRED["demand"] if c not in demand.columns]
    parts = [fixed(demand.sparkSession, [("ERROR", file, "missing_column", c) for c in missing])]
    if "volume" not in missing:
        parts.append(finding(demand.filter(number(F.col("volume")) < 0), "ERROR", file, "negative_volume", F.col("volume")))
    if not missing:
        zones = F.broadcast(node.select(whole(F.col("zone_id")).alias("z")).filter("z > 0").distinct())  # a row a zone
        ends = demand.select(F.explode(F.array(whole(F.col("o_zone_id")), whole(F.col("d_zone_id")))).alias("z")).filter("z > 0")
        parts.append(finding(ends.join(zones, "z", "left_anti").agg(F.count("*").alias("n")).filter("n > 0"), "WARNING", file, "unknown_zones", F.col("n")))
    return union(parts)


def check_movements(movement: DataFrame, link: DataFrame) -> DataFrame:
    """Movements whose links are not in the network; such bans would have no effect."""
    ids = link.select(whole(F.col("link_id").cast("string")).alias("n")).distinct()
    return union([finding(movement.filter(whole(F.col(c).cast("string")).isNotNull()).join(ids, whole(F.col(c).cast("string")) == F.col("n"), "left_anti"), "ERROR", "movement", f"unknown_{c}", F.col(c)) for c in ("ib_link_id", "ob_link_id")])


def check_settings(settings: dict, spark, present: set[str], modes: list[dict]) -> DataFrame:
    """Findings on the period and on files: settings that are absent, an end before its start, demand files that aren't there."""
    rows = [] if "settings.csv" in present else [("WARNING", "settings", "missing_file", "settings.csv")]
    start, end = settings.get("demand_period_starting_hours"), settings.get("demand_period_ending_hours")
    if start is not None and end is not None and end <= start:
        rows.append(("ERROR", "settings", "period_order", f"{start:g}-{end:g}"))
    rows += [("WARNING", "mode_type", "missing_demand", m["demand_file"]) for m in modes if m.get("demand_file") and m["demand_file"] not in present]
    return fixed(spark, rows)


def by_severity(findings: DataFrame, order: tuple = ("ERROR", "WARNING", "INFO")) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("severity"))
    return findings.orderBy(F.when(rank == 0, len(order) + 1).otherwise(rank), "file", "code", "item")


def fill_with_log(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with defaults, (column, filled): how many values each default gave); blank text counts as missing."""
    blank = {c: F.when(F.trim(F.col(c)) == "", F.lit(None)).otherwise(F.col(c)) for c, t in links.dtypes if t == "string"}
    clean = links.withColumns(blank) if blank else links
    filled = fill_defaults(clean)
    columns = [c for c in LINK_DEFAULTS if c in links.columns]
    counts = clean.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in columns])
    return filled, counts.unpivot([], columns, "column", "filled").filter("filled > 0")


def infeasible_origins(links: DataFrame, modes: DataFrame, demand: DataFrame) -> DataFrame:
    """mode, o, volume of origins with demand and no link out that their class may use."""
    return _without(links, modes, demand, "o", "from_node_id")


def infeasible_destinations(links: DataFrame, modes: DataFrame, demand: DataFrame) -> DataFrame:
    """mode, d, volume of destinations with demand and no link in that their class may use."""
    return _without(links, modes, demand, "d", "to_node_id")


def _without(links: DataFrame, modes: DataFrame, demand: DataFrame, end: str, link_end: str) -> DataFrame:
    have = links.join(F.broadcast(modes.select("mode")), allowed(F.col("allowed_use"), F.col("mode"))).select("mode", F.col(link_end).alias(end)).distinct()
    return demand.groupBy("mode", end).agg(F.sum("volume").alias("volume")).filter("volume > 0").join(have, ["mode", end], "left_anti")


def access(links: DataFrame, modes: DataFrame, demand: DataFrame, pairs: DataFrame) -> DataFrame:
    """mode, kind, o, d, volume: demanded pairs that can't be served, by the first reason.

    no_out: no link out of the origin; no_in: none into the destination; no_path: neither, but no path.
    pairs: as ``paths.load_pairs`` returns them, without turn bans or centroid rules if those shall not count.
    """
    out = infeasible_origins(links, modes, demand).select("mode", "o", F.lit(True).alias("no_out"))
    into = infeasible_destinations(links, modes, demand).select("mode", "d", F.lit(True).alias("no_in"))
    cut = pairs.filter("links IS NULL").select("mode", "o", "d", "volume").join(out, ["mode", "o"], "left").join(into, ["mode", "d"], "left")
    return cut.select("mode", F.when(F.col("no_out"), "no_out").when(F.col("no_in"), "no_in").otherwise("no_path").alias("kind"), "o", "d", "volume")


def zone_degrees(links: DataFrame, modes: DataFrame, zones: DataFrame) -> DataFrame:
    """mode, zone_id, out_links, in_links of every zone and class; zeros where a class can't leave or enter."""
    use = links.join(F.broadcast(modes.select("mode")), allowed(F.col("allowed_use"), F.col("mode")))
    ends = use.select("mode", F.col("from_node_id").alias("zone_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(use.select("mode", F.col("to_node_id").alias("zone_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    got = ends.groupBy("mode", "zone_id").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))
    return zones.select("zone_id").crossJoin(F.broadcast(modes.select("mode"))).join(got, ["mode", "zone_id"], "left").fillna(0, ["out_links", "in_links"])


def declarations(declared: DataFrame, facts: dict, hours: float | None) -> DataFrame:
    """Findings on what a submission declares, worst first. declared: key, value (see ``edits.declared``).

    facts: median length, peak load factors (sorted list) of the links. Undeclared keys have their own
    severity; declarations that the data speak against are decisions.
    """
    have = {r["key"]: r["value"] for r in declared.collect()}  # a handful of lines
    rows = [(s, "submission", "undeclared", k) for k, s in DECLARATIONS if not have.get(k)]
    if not have:
        rows.insert(0, ("BLOCKER", "submission", "no_submission", "submission.yml"))
    flat = [round(p, 4) for p in facts.get("plf", [])] == [1.0]
    long = bool(hours and hours > 1)
    if have.get("capacity_period") == "daily" and hours:
        rows.append(("DECISION", "submission", "daily_capacity", "capacity_period"))
    if not have.get("capacity_period") and long and flat:
        rows.append(("BLOCKER", "submission", "capacity_undefined", "capacity_period"))
    median, unit = facts.get("length"), have.get("length_unit")
    if median is not None and unit and unit != ("m" if median > 100 else "mi") and not (unit == "km" and median > 1):
        rows.append(("DECISION", "submission", "length_unit_differs", unit))
    if long and flat and not have.get("peak_load_factor"):
        rows.append(("DECISION", "submission", "flat_plf", "peak_load_factor"))
    return by_severity(fixed(declared.sparkSession, rows), SEVERITIES)


def link_facts(links: DataFrame) -> dict:
    r = links.agg(F.percentile("length", F.lit(0.5)).alias("length"), F.array_sort(F.collect_set(F.round("plf", 4))).alias("plf")).first()
    return {"length": r["length"], "plf": r["plf"] or []}


def gate(findings: DataFrame) -> DataFrame:
    """One row: BLOCKED where a finding blocks, else READY, and the number of each severity."""
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in SEVERITIES]
    return findings.agg(*counts).withColumn("gate", F.when(F.col("blocker") > 0, "BLOCKED").otherwise("READY"))
