"""Scenario folders: read, check, assign, report. ``python -m equiflow assign FOLDER`` and the like."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assign as solver
from .operators import checks, edits, estimate, paths, reports, staging, workflow
from .sources import gmns
from .sources.shared import exists, write_text

COMMANDS = ("assign", "run", "validate", "fill", "inventory", "accessibility", "check", "report", "skim", "demand-bin", "simulate", "match", "plf", "intake", "manifest", "gaps", "schema", "guide", "workflow", "adapt", "nexta", "odme", "routes")


@dataclass
class Scenario:
    spark: SparkSession
    folder: str
    nodes: DataFrame
    links: DataFrame
    modes: DataFrame
    demand: DataFrame
    settings: dict
    movements: DataFrame | None


def place(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def load(spark: SparkSession, folder: str) -> Scenario:
    """A scenario in any file system that Spark reads."""
    at = lambda name: place(folder, name)
    have = lambda name: exists(spark, at(name))
    nodes = gmns.nodes(spark, at("node.csv"))
    modes = gmns.modes(spark, at("mode_type.csv")) if have("mode_type.csv") else gmns.default_modes(spark)
    settings = gmns.settings(spark, at("settings.csv")) if have("settings.csv") else {}
    demand = None
    for m in modes.collect():
        binary = os.path.splitext(m["demand_file"])[0] + ".bin"
        if settings.get("demand_format") == 1 and have(binary) and gmns.is_binary_demand(spark, at(binary)):
            part = gmns.read_binary_demand(spark, at(binary), m["mode"])
        elif have(m["demand_file"]):
            part = gmns.demand(spark, at(m["demand_file"]), m["mode"])
        else:
            continue
        demand = part if demand is None else demand.unionByName(part)
    zones = nodes.filter("zone_id > 0").select("zone_id")
    if demand is None:  # a single class without a file: one trip between all zones
        demand = zones.select(F.lit("auto").alias("mode"), F.col("zone_id").alias("o"), F.lit(1.0).alias("volume")).crossJoin(zones.withColumnRenamed("zone_id", "d")).select("mode", "o", "d", "volume")
    demand, _ = gmns.known_zones(demand, nodes)
    moves = gmns.movements(spark, at("movement.csv")) if have("movement.csv") else None
    return Scenario(spark, folder, nodes, gmns.links(spark, at("link.csv"), nodes), modes, demand, settings, moves)


def first_through(s: Scenario) -> int:
    """-1 (or absent): the first node of the file that is no zone; 0: no limit; else the given id."""
    given = int(s.settings.get("first_through_node_id", -1))
    if given >= 0:
        return given
    low = s.nodes.filter("zone_id = 0").agg(F.min_by("node_id", "pos")).first()[0]
    return low if low is not None else 0


def bans(s: Scenario) -> DataFrame | None:
    """Turns that the scenario forbids: movements with a high penalty, and U-turns where its links say so."""
    uturns = not s.links.filter("no_uturn = 1").isEmpty()
    if s.movements is None and not uturns:
        return None
    return reports.turn_bans(s.links, s.movements, uturns)


def period_hours(s: Scenario) -> float:
    return edits.period_hours(s.settings.get("demand_period_starting_hours", 7), s.settings.get("demand_period_ending_hours", 8))


def solver_settings(s: Scenario) -> solver.Settings:
    method = {0: "fw", 1: "cfw", 2: "bfw"}[int(s.settings.get("assignment_method", 0))]
    target = s.settings.get("convergence_gap_pct") or None
    return solver.Settings(int(s.settings.get("number_of_iterations", 20)), period_hours(s), first_through(s), method, target, int(s.settings.get("convergence_consecutive", 1)), s.settings.get("added_delay_per_mile", 0.0), s.settings.get("relative_gap_standard", 0) == 1)


def assign(s: Scenario) -> solver.Result:
    """Equilibrium under the scenario's own turn bans, classes and base volumes."""
    base = None
    if s.settings.get("base_demand_mode", 0) == 1:
        parts = [gmns.demand(s.spark, place(s.folder, f"base_{m['demand_file']}"), m["mode"]) for m in s.modes.collect() if exists(s.spark, place(s.folder, f"base_{m['demand_file']}"))]
        base = checks.union(parts) if parts else s.demand.limit(0)
    return solver.assign(s.links, s.demand, s.modes, solver_settings(s), bans(s), base)


def _search(s: Scenario) -> dict:
    rows = s.modes.orderBy("k").collect()
    return {"first_thru": first_through(s), "bans": bans(s), "undedicated": tuple(m["mode"] for m in rows if not m["dedicated"]), "leader": rows[0]["mode"]}


def results(s: Scenario, r: solver.Result) -> dict[str, DataFrame]:
    """The result tables: links, pairs, system, origins, destinations, pairs without a path, queues, zone averages."""
    links = r.to_frame(s.spark)
    hours = period_hours(s)
    performance = reports.link_performance(links, hours, modes=s.modes, added_per_mile=s.settings.get("added_delay_per_mile", 0.0))
    pairs = paths.load_pairs(links, s.demand, "travel_time", **_search(s))
    free = paths.load_pairs(links, s.demand, "fftt", **_search(s)).select("mode", "o", "d", F.col("cost").alias("free_minutes"))
    lengths, zones = links.select("link_id", "length"), s.nodes.filter("zone_id > 0")
    n = zones.count()
    start = s.settings.get("demand_period_starting_hours", 7.0)
    return {
        "link_performance": performance,
        "od_performance": edits.od_report(pairs, s.nodes, n),
        "system_performance": reports.system_performance(pairs, lengths, s.modes).join(reports.delay_performance(pairs, lengths, free).drop("hours"), "mode"),
        "origin_accessibility": reports.accessibility(pairs, zones, "o", lengths),
        "destination_accessibility": reports.accessibility(pairs, zones, "d", lengths),
        "inaccessible_od": pairs.filter("links IS NULL").select("mode", "o", "d", "volume"),
        "queues": reports.queue_report(links, start, start + hours),
        "totals": reports.totals(pairs, lengths),
    }


def routes(s: Scenario, r: solver.Result | None = None) -> tuple[DataFrame, DataFrame]:
    """(routes of all iterations with their shares, background volumes), by plain Frank-Wolfe steps."""
    p = solver.Problem(s.links, s.demand, s.modes, solver_settings(s), bans(s))
    r = r or assign(s)
    volume, out = None, None
    for k in range(len(r.steps) + 1):
        times = p.times(np.zeros(len(p.links)) if volume is None else volume)
        links = s.spark.createDataFrame(p.links.assign(now=times)[["link_id", "from_node_id", "to_node_id", "length", "allowed_use", "now"]])
        found = paths.load_pairs(links, s.demand, "now", **_search(s)).filter("links IS NOT NULL").withColumn("iteration", F.lit(k))
        out = found if out is None else out.unionByName(found)
        y, _ = p.load(times)
        step = 1.0 if k == 0 else r.steps[k - 1]
        volume = p.total(y) if volume is None else volume + step * (p.total(y) - volume)
    return edits.numbered_routes(edits.merge_routes(out, r.shares()), s.nodes.filter("zone_id > 0").count())


def odme(s: Scenario, iterations: int = 20) -> DataFrame:
    """Pairs with volumes moved towards the counts of the links (obs_volume) from their own as target."""
    links = assign(s).to_frame(s.spark)
    pairs = paths.load_pairs(links, s.demand, "travel_time", **_search(s)).withColumn("target", F.col("volume"))
    vmt = s.settings.get("odme_vmt", 0.0)
    return estimate.estimate(pairs, s.links.select("link_id", F.col("obs_volume").alias("obs")), iterations, w_vmt=1e-6 if vmt else 0.0, vmt=vmt)


def simulate(s: Scenario) -> DataFrame:
    """The vehicles of vehicle.csv on the links; those that share no road run apart."""
    return estimate.simulate(s.links, gmns.vehicles(s.spark, place(s.folder, "vehicle.csv")), period_hours(s))


def match(s: Scenario) -> DataFrame:
    """The nearest link of each position in trace.csv."""
    end = lambda k: s.nodes.select(F.col("node_id").alias(f"n{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    lines = s.links.join(end(1), F.col("from_node_id") == F.col("n1")).join(end(2), F.col("to_node_id") == F.col("n2"))
    return estimate.match_points(gmns.traces(s.spark, place(s.folder, "trace.csv")), lines.select("link_id", "x1", "y1", "x2", "y2"))


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """All findings on the files of a folder, worst first. Missing node or link files are the only ones then."""
    at = lambda n: place(folder, n)
    have = {n for n in ("node.csv", "link.csv", "settings.csv", "mode_type.csv", "demand.csv", "movement.csv") if exists(spark, at(n))}
    lost = [n for n in ("node.csv", "link.csv") if n not in have]
    if lost:
        return checks.fixed(spark, [("ERROR", n[:-4], "missing_file", n) for n in lost])
    node, link = gmns.table(spark, at("node.csv")), gmns.table(spark, at("link.csv"))
    settings = gmns.settings(spark, at("settings.csv")) if "settings.csv" in have else {}
    modes = [r.asDict() for r in gmns.modes(spark, at("mode_type.csv")).collect()] if "mode_type.csv" in have else []
    files = [m["demand_file"] for m in modes] or ["demand.csv"]
    have |= {f for f in files if exists(spark, at(f))}
    hours = edits.period_hours(settings.get("demand_period_starting_hours", 7), settings.get("demand_period_ending_hours", 8))
    parts = [checks.check_tables(node, link, [m["mode"] for m in modes], hours), checks.check_settings(settings, spark, have, modes)]
    parts += [checks.check_demand(gmns.table(spark, at(f)), node, f) for f in dict.fromkeys(files) if f in have and not f.endswith(".bin")]
    if "movement.csv" in have and "link_id" in link.columns:
        parts.append(checks.check_movements(gmns.table(spark, at("movement.csv")), link))
    return checks.by_severity(checks.union(parts))


def adapted(spark: SparkSession, folder: str, **options) -> dict[str, DataFrame]:
    """link and demand tables of a folder in our layout."""
    nodes = gmns.nodes(spark, place(folder, "node.csv"))
    out = {"link": staging.adapt_links(gmns.table(spark, place(folder, "link.csv")), **options)}
    if exists(spark, place(folder, "demand.csv")):
        kept, _ = gmns.known_zones(gmns.demand(spark, place(folder, "demand.csv")), nodes)
        out["demand"] = kept.select(F.col("o").alias("o_zone_id"), F.col("d").alias("d_zone_id"), "volume")
    return out


def converted(spark: SparkSession, folder: str, period: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(link and mode_type of one period of a multi-period folder, the log of what was done)."""
    text = "\n".join(r[0] for r in spark.read.text(place(folder, "settings.csv")).collect())  # a settings file
    settings = gmns.nexta_settings(text)
    links, said = staging.single_period(gmns.table(spark, place(folder, "link.csv")), gmns.nodes(spark, place(folder, "node.csv")), settings, period)
    # File beginnings and classes, for periods that the settings list no files of.
    names = (("da", "sov"), ("sr2", "hov2"), ("sr3", "hov3"), ("sut", "sut"), ("mut", "mut"))
    files = said["demand_files"] or [{"file": f"{pre}_{period.lower()}.csv", "agent": who} for pre, who in names if exists(spark, place(folder, f"{pre}_{period.lower()}.csv"))]
    kinds = settings["agent_types"]
    modes = [(f["agent"], float(kinds.get(f["agent"], {}).get("vot", 10.0)), float(kinds.get(f["agent"], {}).get("pce", 1.0)), 1.0, f["file"], 1) for f in files]
    log = [("INPUT", "link.csv", "", "columns numbered by period"), ("STEP", "period", said["period"], f"{said['start']:g} to {said['end']:g} h"), ("MAP", "capacity", f"VDF_cap{said['number']} / (lanes * hours)", "hourly, of a lane"), ("MAP", "vdf_length_mi", "time * speed / 60", ""), ("ASSUME", "capacity_period", "hourly", ""), ("ASSUME", "length_unit", "mi", ""), ("OUTPUT", "link.csv", "", "")]
    return {"link": links, "mode_type": spark.createDataFrame(modes, "mode_type string, vot double, pce double, occ double, demand_file string, dedicated_shortest_path int")}, staging.conversion_log(spark, log)


def peak_factors(s: Scenario) -> DataFrame:
    """link_type, links, mean and bounded peak load factor, and how many links have one and the same."""
    bounded = reports.bound_plf(F.col("plf"), period_hours(s))
    return s.links.groupBy("link_type").agg(F.count("*").alias("links"), F.avg("plf").alias("plf"), F.avg(bounded).alias("bounded"), F.sum((bounded != F.col("plf")).cast("int")).alias("out_of_bounds"), F.countDistinct("plf").alias("values"))


def gates(s: Scenario) -> DataFrame:
    """stage, gate of everything that should hold before a run, and the worst of them as stage ``all``."""
    found = findings(s.spark, s.folder)
    cut = paths.load_pairs(s.links, s.demand, "fftt", **_search(s)).filter("links IS NULL AND volume > 0 AND o <> d")
    worst = found.agg(F.max(F.when(F.col("severity") == "ERROR", 2).otherwise(1)).alias("w")).select(F.lit("validate").alias("stage"), F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "WARN").otherwise("PASS").alias("gate"))
    filled = checks.fill_with_log(s.links)[1].agg(F.count("*").alias("n")).select(F.lit("fill").alias("stage"), F.when(F.col("n") > 0, "WARN").otherwise("PASS").alias("gate"))
    use = reports.use_classes(s.links, s.modes).filter("class = 'closed'").agg(F.count("*").alias("n")).select(F.lit("inventory").alias("stage"), F.lit("PASS").alias("gate"))
    reach = cut.agg(F.count("*").alias("n")).select(F.lit("accessibility").alias("stage"), F.when(F.col("n") > 0, "WARN").otherwise("PASS").alias("gate"))
    stages = checks.union([worst, filled, use, reach])
    return stages.unionByName(edits.worst_gate(stages).select(F.lit("all").alias("stage"), "gate"))


def schema() -> dict:
    """The columns of the input files: those that must be there, and the others' defaults."""
    return {"required": {f: list(c) for f, c in checks.REQUIRED.items()}, "link_defaults": {c: v for c, v in gmns.PARAMETERS.values()}, "declarations": [k for k, _ in checks.DECLARATIONS]}


GUIDE = """A scenario is a folder with node.csv and link.csv; settings.csv, mode_type.csv, demand files,
movement.csv, vehicle.csv, trace.csv and submission.yml are read where they are.

    python -m equiflow validate FOLDER     findings on the files (exit code 1 with an error)
    python -m equiflow check FOLDER        all gates before a run
    python -m equiflow assign FOLDER       equilibrium; run: with all result tables
    python -m equiflow workflow FOLDER     the staged report R1 to R6

--out FOLDER writes tables there; --format csv or parquet."""


def save(df: DataFrame, folder: str, name: str, how: str) -> None:
    if how == "csv":
        gmns.write_csv(df, place(folder, name))
    else:
        df.write.mode("overwrite").parquet(place(folder, name))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="equiflow")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("folder", nargs="?", default=".")
    p.add_argument("--out", help="folder for results; printed where absent")
    p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    p.add_argument("--period", default="AM", help="period for nexta")
    a = p.parse_args(argv)
    if a.command == "schema":
        print(json.dumps(schema(), indent=2))
        return 0
    if a.command == "guide":
        print(GUIDE)
        return 0
    spark = SparkSession.builder.appName("equiflow").getOrCreate()
    code, tables, text = 0, {}, None
    if a.command == "validate":
        tables["validate"] = findings(spark, a.folder)
        code = int(not tables["validate"].filter("severity = 'ERROR'").isEmpty())
    elif a.command == "adapt":
        tables = adapted(spark, a.folder)
    elif a.command == "nexta":
        tables, tables["conversion_log"] = converted(spark, a.folder, a.period)
    elif a.command == "manifest":
        tables["manifest"] = edits.manifest(spark, [place(a.folder, "*.csv")])
    elif a.command == "gaps":
        tables["gaps"] = gmns.gap_log(spark, place(a.folder, "summary_log_file.txt"))
    else:
        s = load(spark, a.folder)
        if a.command in ("assign", "run"):
            r = assign(s)
            print(json.dumps(r.summary() | {"steps": r.steps}))
            tables = {"assign": r.to_frame(spark)} if a.command == "assign" else results(s, r)
        elif a.command == "fill":
            tables["fill"], tables["filled"] = checks.fill_with_log(s.links)
        elif a.command == "inventory":
            tables["inventory"] = reports.use_classes(s.links, s.modes)
            tables["by_mode"] = reports.mode_costs(s.links, s.modes).groupBy("mode").agg(F.sum(F.col("allowed").cast("long")).alias("links"))
        elif a.command == "report":
            r = assign(s)
            perf = reports.link_performance(r.to_frame(spark), period_hours(s))
            tables["report"] = perf.groupBy("link_type").agg(F.count("*").alias("links"), F.sum("VMT").alias("VMT"), F.sum("VHT").alias("VHT"))
            tables["classes"] = perf.agg(*[F.sum(c).alias(c[8:]) for c in perf.columns if c.startswith("mod_vol_")])
            tables["iterations"] = spark.createDataFrame([(i + 1, float(g)) for i, g in enumerate(r.gaps)], "iteration int, gap_percent double")
        elif a.command == "simulate":
            tables["simulate"] = simulate(s)
        elif a.command == "match":
            tables["match"] = match(s)
        elif a.command == "odme":
            tables["odme"] = odme(s)
        elif a.command == "routes":
            tables["routes"], tables["background"] = routes(s)
        elif a.command == "plf":
            tables["plf"] = peak_factors(s)
        elif a.command == "intake":
            lines = spark.read.text(place(a.folder, "submission.yml")) if exists(spark, place(a.folder, "submission.yml")) else spark.createDataFrame([], "value string")
            tables["intake"] = checks.declarations(edits.declared(lines), checks.link_facts(s.links), period_hours(s))
            tables["gate"] = checks.gate(tables["intake"])
            code = int(tables["gate"].first()["gate"] == "BLOCKED")
        elif a.command == "check":
            tables["check"] = gates(s)
            code = int(not tables["check"].filter("gate = 'FAIL'").isEmpty())
        elif a.command == "workflow":
            perf = reports.link_performance(assign(s).to_frame(spark), period_hours(s))
            tables["stages"] = workflow.stages(s.links, s.demand, period_hours(s), perf)
            tables |= {"lane_miles": workflow.lane_miles(s.links, "link_type"), "od_by_class": workflow.demand_by_class(s.demand), "allowed_use": workflow.use_groups(s.links), "parameters": workflow.parameters_by_code(s.links), "plf": workflow.plf_by(s.links, "link_type")}
            text = workflow.markdown(f"Workflow of {a.folder}", tables)
        elif a.command == "demand-bin":
            tables["demand-bin"] = spark.createDataFrame([(gmns.write_binary_demand(s.demand, os.path.join(a.out or a.folder, "demand.bin")),)], "records long")
        elif a.command == "skim":
            tables["skim"] = paths.skim(s.links, s.nodes.filter("zone_id > 0").select(F.col("node_id").alias("o")), "fftt", floor=1e-6, digits=4)
        else:
            tables["accessibility"] = checks.access(s.links, s.modes, s.demand, paths.load_pairs(s.links, s.demand, "fftt"))
    for name, df in tables.items():
        if a.out and a.command != "demand-bin":
            save(df, a.out, name, a.format)
        else:
            df.show(50, truncate=False)
    if text and a.out:
        write_text(spark, place(a.out, "workflow.md"), text)
        write_text(spark, place(a.out, "workflow.html"), workflow.page(f"Workflow of {a.folder}", tables))
    return code


if __name__ == "__main__":
    sys.exit(main())
