"""Readers and writers of network tables: named CSV columns with loose numbers, and binary demand."""

from __future__ import annotations

import csv
import re
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The delay parameters of a link besides alpha, beta and plf: their column in link.csv and its default.
PARAMETERS = {"linear": ("vdf_A", 0.0), "conic_a": ("conic_a", 0.0), "conic_b": ("conic_b", 0.0), "cp": ("vdf_cp", 0.28125), "cd": ("vdf_cd", 1.0), "n": ("vdf_n", 1.0), "s": ("vdf_s", 4.0), "green": ("green_ratio", 0.45)}
NUMBER, WHOLE = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", r"^\s*([+-]?\d+)"


def table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by name. A byte order mark is dropped; of a repeated name the last column counts."""
    first = spark.read.text(path).first()
    names = [n.strip().lstrip("﻿") for n in next(csv.reader([first[0]]))] if first else []
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(len(names)))).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(*[F.trim(F.col(f"c{i}")).alias(n) for n, i in {n: i for i, n in enumerate(names) if n}.items()])


def number(c: Column) -> Column:
    """The number a text begins with (``1800x`` is 1800); null where it begins with none."""
    return F.nullif(F.regexp_extract(c, NUMBER, 1), F.lit("")).cast("double")


def whole(c: Column) -> Column:
    """The whole number a text begins with: ``1.5`` is 1."""
    return F.nullif(F.regexp_extract(c, WHOLE, 1), F.lit("")).cast("long")


def _get(df: DataFrame, name: str, default, read=number) -> Column:
    return F.coalesce(read(F.col(f"`{name}`")), F.lit(default)) if name in df.columns else F.lit(default)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, zone_id, x, y and pos, the place in the file."""
    t = table(spark, path)
    return t.select(F.monotonically_increasing_id().alias("pos"), whole(F.col("node_id")).alias("node_id"), _get(t, "zone_id", 0, whole).cast("long").alias("zone_id"), _get(t, "x_coord", 0.0).alias("x"), _get(t, "y_coord", 0.0).alias("y")).filter("node_id IS NOT NULL")


def links(spark: SparkSession, path: str, node: DataFrame | None = None) -> DataFrame:
    """Links with the engine's derivations; rows without capacity, lanes or speed, or with unknown ends, are left out."""
    t = table(spark, path)
    get = lambda n, d, r=number: _get(t, n, d, r)
    over = lambda n, x, ok: F.when(ok(get(n, -1.0)), get(n, -1.0)).otherwise(x)
    df = t.select(
        get("link_id", None, whole).cast("long").alias("link_id"), whole(F.col("from_node_id")).alias("from_node_id"), whole(F.col("to_node_id")).alias("to_node_id"),
        get("lanes", 1, whole).alias("lanes"), get("capacity", 0.0).alias("capacity"),
        over("vdf_free_speed_mph", get("free_speed", 10.0) / 1.609, lambda c: c > 0).alias("free_speed"),
        over("vdf_length_mi", get("length", 0.0) / 1609.0, lambda c: c >= 0).alias("length"), get("vdf_fftt", -1.0).alias("given"),
        get("vdf_type", 0, whole).alias("vdf_type"), get("vdf_alpha", 0.15).alias("alpha"), get("vdf_beta", 4.0).alias("beta"), get("vdf_plf", 1.0).alias("plf"),
        F.coalesce(*[number(F.col(n)) for n in ("toll", "vdf_toll") if n in t.columns], F.lit(0.0)).alias("toll"), get("link_type", 1, whole).alias("link_type"),
        *[get(c, v).alias(n) for n, (c, v) in PARAMETERS.items()], get("cutoff_speed", -1.0).alias("cutoff"), get("base_demand_volume", 0.0).alias("base_volume"), *[get(c, 0.0).alias(c) for c in t.columns if c.startswith("base_vol_")], *[get(c, -1.0).alias(c) for c in t.columns if c.startswith("obs_volume_")],
        get("non_uturn_flag", 0, whole).alias("no_uturn"), get("ref_volume", 0.0).alias("ref_volume"), get("obs_volume", -1.0).alias("obs_volume"), (F.coalesce("allowed_use", F.lit("")) if "allowed_use" in t.columns else F.lit("")).alias("allowed_use"),
        (F.col("geometry") if "geometry" in t.columns else F.lit("")).alias("geometry"),
    )
    df = df.filter("lanes > 0 AND capacity >= 0.0001 AND free_speed >= 0.0001 AND from_node_id IS NOT NULL AND to_node_id IS NOT NULL")
    df = df.withColumn("fftt", F.when(F.col("given") >= 0, F.col("given")).otherwise(F.col("length") / F.col("free_speed") * 60)).drop("given")
    df = df.withColumn("cutoff", F.when(F.col("cutoff") > 0, F.col("cutoff")).otherwise(0.75 * F.col("free_speed")))
    df = df.withColumn("link_id", F.coalesce("link_id", F.col("from_node_id") * 1_000_000 + F.col("to_node_id")))
    if node is not None:
        known = F.broadcast(node.select("node_id"))
        for end in ("from_node_id", "to_node_id"):
            df = df.join(known, df[end] == known.node_id, "left_semi")
    return df


def demand(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """mode, o, d, volume, by name of the columns, else by their place; of repeated pairs the last row counts."""
    t = table(spark, path)
    names = [next((c for c in t.columns if c == n), t.columns[i] if i < len(t.columns) else None) for i, n in enumerate(("o_zone_id", "d_zone_id", "volume"))]
    raw = t.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(names, "abv", strict=True)])
    rows = raw.select(whole(F.col("a")).alias("o"), whole(F.col("b")).alias("d"), number(F.col("v")).alias("volume"), F.monotonically_increasing_id().alias("at"))
    return rows.filter("o IS NOT NULL AND d IS NOT NULL").groupBy("o", "d").agg(F.max_by("volume", "at").alias("volume")).select(F.lit(mode).alias("mode"), "o", "d", "volume")


def modes(spark: SparkSession, path: str) -> DataFrame:
    t = table(spark, path)
    get = lambda n, d: _get(t, n, d)
    return t.select(F.col("mode_type").alias("mode"), get("vot", 10.0).alias("vot"), get("pce", 1.0).alias("pce"), get("occ", 1.0).alias("occ"), get("operating_cost", 0.0).alias("operating_cost"), (F.coalesce("demand_file", F.lit("demand.csv")) if "demand_file" in t.columns else F.lit("demand.csv")).alias("demand_file"), (get("dedicated_shortest_path", 1.0) != 0).alias("dedicated"), (F.monotonically_increasing_id() + 1).alias("k"))


def default_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("auto", 10.0, 1.0, 1.0, 0.0, "demand.csv", True, 1)], "mode string, vot double, pce double, occ double, operating_cost double, demand_file string, dedicated boolean, k long")


def settings(spark: SparkSession, path: str) -> dict[str, float]:
    row = table(spark, path).limit(1).collect()
    out = {}
    for k, v in (row[0].asDict() if row else {}).items():
        try:
            out[k] = float(v)
        except (TypeError, ValueError):
            pass
    return out


def movements(spark: SparkSession, path: str) -> DataFrame:
    t = table(spark, path)
    return t.select(whole(F.col("ib_link_id")).alias("ib_link_id"), whole(F.col("ob_link_id")).alias("ob_link_id"), _get(t, "penalty", 0.0).alias("penalty"))


def known_zones(trips: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trips between zones of the network; per class the rows and volume left out)."""
    zone = F.broadcast(nodes.filter("zone_id > 0").select("zone_id").distinct())  # a row a zone
    both = trips.join(zone.select(F.col("zone_id").alias("o"), F.lit(True).alias("ko")), "o", "left").join(zone.select(F.col("zone_id").alias("d"), F.lit(True).alias("kd")), "d", "left")
    out = both.filter("ko IS NULL OR kd IS NULL").groupBy("mode").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))
    return both.filter("ko AND kd").select("mode", "o", "d", "volume"), out


def repeated_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(o, d, rows) of the pairs that a demand file holds more than once."""
    t = table(spark, path)
    return t.groupBy(whole(F.col(t.columns[0])).alias("o"), whole(F.col(t.columns[1])).alias("d")).agg(F.count("*").alias("rows")).filter("rows > 1")


def link_times(spark: SparkSession, path: str, field: str = "travel_time", remap: DataFrame | None = None) -> DataFrame:
    """from_node_id, to_node_id and ``field`` of a link performance file; of repeated ends the last row counts.

    remap: node_id, new_id; ends that it doesn't hold stay as they are.
    """
    t = table(spark, path)
    rows = t.select(whole(F.col("from_node_id")).alias("from_node_id"), whole(F.col("to_node_id")).alias("to_node_id"), number(F.col(field)).alias(field), F.monotonically_increasing_id().alias("at"))
    if remap is not None:
        ids = F.broadcast(remap.select("node_id", "new_id"))
        for end in ("from_node_id", "to_node_id"):
            rows = rows.join(ids, rows[end] == ids.node_id, "left").withColumn(end, F.coalesce("new_id", end)).drop("node_id", "new_id")
    return rows.groupBy("from_node_id", "to_node_id").agg(F.max_by(field, "at").alias(field))


def nexta_settings(text: str) -> dict:
    """The sections of a multi-section settings file: iterations, agent_types, periods, demand_files."""
    out, section = {"iterations": 1, "agent_types": {}, "periods": {}, "demand_files": []}, ""
    loose = lambda v, d: float(v) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) else d
    for row in csv.reader(text.lstrip("\ufeff").splitlines()):
        cells = [c.strip() for c in row]
        if not cells:
            continue
        if cells[0].startswith("["):
            section = cells[0].strip("[]")
        elif section == "assignment" and len(cells) > 3 and cells[2] in ("ue", "dta", "odme"):
            out["iterations"] = int(loose(cells[3], 1))
        elif section == "agent_type" and len(cells) > 6 and cells[1] not in ("", "agent_type"):
            out["agent_types"][cells[1]] = {"vot": loose(cells[4], 10.0), "pce": loose(cells[6], 1.0)}
        elif section == "demand_period":
            # a period's cells may be shifted to the right: number, name, hours
            at = next((i for i, c in enumerate(cells) if c.isdigit()), None)
            rest = [c for c in cells[at + 1 :] if c] if at is not None else []
            hours = next((c for c in rest if "_" in c), None)
            if hours:
                out["periods"][cells[at]] = {"name": rest[0], "time_period": hours}
        elif section == "demand_file_list" and len(cells) > 6 and cells[1].isdigit():
            out["demand_files"].append({"file": cells[2], "period": cells[5], "agent": cells[6]})
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with a head each, as Spark writes them; the sink of result tables."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def vehicles(spark: SparkSession, path: str) -> DataFrame:
    """agent_id, departure_minute, o, d, links: the trips of a simulation; a closing ``;`` names no link."""
    t = table(spark, path)
    ids = F.filter(F.transform(F.split("link_ids", ";"), lambda x: whole(x)), lambda x: x.isNotNull())
    return t.select(whole(F.col("agent_id")).alias("agent_id"), number(F.col("departure_time")).alias("departure_minute"), _get(t, "o_zone_id", 0, whole).alias("o"), _get(t, "d_zone_id", 0, whole).alias("d"), ids.alias("links")).filter("agent_id IS NOT NULL AND departure_minute IS NOT NULL")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """agent_id, trace_no, x, y: recorded positions; rows without a position are left out."""
    t = table(spark, path)
    return t.select("agent_id", whole(F.col("trace_no")).alias("trace_no"), number(F.col("x_coord")).alias("x"), number(F.col("y_coord")).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")


def gap_log(spark: SparkSession, path: str) -> DataFrame:
    """iteration, step, system_vmt, system_tt, least_tt, gap_percent of each logged iteration; other lines are skipped."""
    # The labels of a log line.
    labels = {"iteration": "iter No =", "step": "Lambda =", "system_vmt": "g_System_VMT =", "system_tt": "sys. TT =", "least_tt": "least TT =", "gap_percent": "gap ="}
    lines = spark.read.text(path).filter(F.col("value").startswith("iter No ="))
    found = lines.select(*[number(F.substring_index("value", label, -1)).alias(n) for n, label in labels.items()])
    return found.withColumn("iteration", F.col("iteration").cast("long"))


def read_binary_demand(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """Binary demand: a 16-byte head (``DTAB``, version, count), then 16-byte records (o, d, volume)."""

    def decode(rows):
        held = []
        for r in rows:
            if r[:4] != b"DTAB":
                held.append(bytes(r))
            if len(held) == 65_536:
                yield from np.frombuffer(b"".join(held), "<i4,<i4,<f8").tolist()
                held = []
        yield from np.frombuffer(b"".join(held), "<i4,<i4,<f8").tolist()

    # head and records are of one length, so the file splits anywhere
    got = spark.sparkContext.binaryRecords(path, 16).mapPartitions(decode)
    return spark.createDataFrame(got, "o long, d long, volume double").select(F.lit(mode).alias("mode"), "o", "d", "volume")


def is_binary_demand(spark: SparkSession, path: str) -> bool:
    """Whether the file begins as binary demand does; others are read as CSV."""
    head = spark.sparkContext.binaryRecords(path, 4).take(1)
    return bool(head) and bytes(head[0]) == b"DTAB"


def write_binary_demand(df: DataFrame, path: str) -> int:
    """Streams positive volumes into one file on the driver; returns their number."""
    n = 0
    with open(path, "wb") as f:
        f.write(struct.pack("<4siq", b"DTAB", 1, 0))
        for r in df.filter("volume > 0").select("o", "d", "volume").toLocalIterator(prefetchPartitions=True):
            f.write(struct.pack("<iid", *r))
            n += 1
        f.seek(8)
        f.write(struct.pack("<q", n))
    return n
