"""The staged report of a scenario: a table and a gate a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .compare import ENDS

STAGE = "stage string, gate string, said string"


def lane_miles(links: DataFrame, *by: str) -> DataFrame:
    """R1: links and lane miles of each group."""
    return links.groupBy(*by).agg(F.count("*").alias("links"), F.sum(F.col("length") * F.coalesce("lanes", F.lit(1))).alias("lane_miles"))


def reverse_paired(links: DataFrame) -> DataFrame:
    """R1: one row with the directed pairs of nodes, and how many of them have a link back."""
    pairs = links.select(*ENDS).distinct()
    back = pairs.select(F.col("to_node_id").alias("from_node_id"), F.col("from_node_id").alias("to_node_id"), F.lit(1).alias("back"))
    return pairs.join(back, ENDS, "left").agg(F.count("*").alias("directed"), F.count("back").alias("paired"))


def demand_by_class(demand: DataFrame) -> DataFrame:
    """R2: pairs with trips, trips, and trips within a zone of each class."""
    return demand.groupBy("mode").agg(F.count(F.when(F.col("volume") != 0, 1)).alias("pairs"), F.sum("volume").alias("trips"), F.sum(F.when(F.col("o") == F.col("d"), F.col("volume")).otherwise(0.0)).alias("within"))


def use_groups(links: DataFrame) -> DataFrame:
    """R2: links of each allowed_use text; a blank one is ``all``."""
    use = F.coalesce("allowed_use", F.lit(""))
    return links.groupBy(F.when(use == "", "all").otherwise(use).alias("allowed_use")).agg(F.count("*").alias("links"))


def parameters_by_code(links: DataFrame, code: str = "vdf_type") -> DataFrame:
    """R3: links, mean alpha and beta, median capacity of each code."""
    return links.groupBy(code).agg(F.count("*").alias("links"), F.avg("alpha").alias("alpha"), F.avg("beta").alias("beta"), F.percentile("capacity", F.lit(0.5)).alias("median_capacity"))


def join_rate(links: DataFrame) -> DataFrame:
    """R3: one row with the links that lack a capacity, those that lack alpha or beta, and the share that is complete."""
    n = links.agg(F.count("*").alias("links"), F.count(F.when(F.col("capacity").isNull(), 1)).alias("no_capacity"), F.count(F.when(F.col("alpha").isNull() | F.col("beta").isNull(), 1)).alias("no_parameters"))
    n = n.withColumn("rate", 100.0 * (F.col("links") - F.greatest("no_capacity", "no_parameters")) / F.greatest("links", F.lit(1)))
    return n.withColumn("gate", F.when((F.col("no_capacity") == 0) & (F.col("no_parameters") == 0), "PASS").when(F.col("rate") > 95, "WARN").otherwise("FAIL"))


def plf_by(links: DataFrame, *by: str) -> DataFrame:
    """R4: mean, least and greatest peak load factor of each group."""
    p = F.coalesce("plf", F.lit(1.0))
    return links.groupBy(*by).agg(F.avg(p).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"))


def plf_gate(links: DataFrame, hours: float, declared: bool = False) -> DataFrame:
    """R4: FAIL where all factors are 1 over several hours and nobody declared that."""
    flat = links.agg((F.min(F.coalesce("plf", F.lit(1.0))) == 1) & (F.max(F.coalesce("plf", F.lit(1.0))) == 1))
    return flat.toDF("flat").withColumn("gate", F.when(F.col("flat") & F.lit(hours > 1 and not declared), "FAIL").otherwise("PASS"))


def identities(performance: DataFrame) -> DataFrame:
    """R5: how far reported vehicle miles and hours are from those recomputed (%), and speeds out of bounds."""
    c = F.col
    a = performance.agg(F.sum("VMT").alias("vmt"), F.sum(c("volume") * c("length")).alias("own_vmt"), F.sum("VHT").alias("vht"), F.sum(c("volume") * c("travel_time") / 60).alias("own_vht"), F.sum(((c("speed") < 0) | (c("speed") > c("free_speed") * 1.05)).cast("long")).alias("out_of_bounds"))
    off = lambda x, y: F.abs(c(x) - c(y)) / F.nullif(x, F.lit(0.0)) * 100
    a = a.select(off("vmt", "own_vmt").alias("vmt_off"), off("vht", "own_vht").alias("vht_off"), "out_of_bounds")
    return a.withColumn("gate", F.when((F.coalesce("vmt_off", F.lit(0.0)) <= 1) & (F.coalesce("vht_off", F.lit(0.0)) <= 1) & (c("out_of_bounds") == 0), "PASS").otherwise("FAIL"))


def against_reference(links: DataFrame, volume: str = "volume", ref: str = "ref_volume") -> DataFrame:
    """R5: r2 of the regression line, slope through the origin, number of links."""
    both = links.filter(F.col(volume).isNotNull() & F.col(ref).isNotNull())
    return both.agg(F.count("*").alias("n"), F.regr_r2(volume, ref).alias("r2"), (F.sum(F.col(volume) * F.col(ref)) / F.nullif(F.sum(F.col(ref) * F.col(ref)), F.lit(0.0))).alias("slope"))


def problem_links(links: DataFrame, volume: str = "volume", ref: str = "ref_volume", off: float = 0.5) -> DataFrame:
    """R5: links further than ``off`` from a reference above 0."""
    return links.filter((F.col(ref) > 0) & (F.abs(F.col(volume) - F.col(ref)) > off * F.col(ref)))


def miles_by_group(performance: DataFrame, *by: str) -> DataFrame:
    """R6: vehicle miles and hours against the reference's of each group; material: it has 1 % of the reference's miles or more.

    performance: VMT, VHT, ref_vmt, ref_vht.
    """
    g = performance.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("VMT", "ref_vmt", "VHT", "ref_vht")])
    total = performance.agg(F.sum(F.coalesce("ref_vmt", F.lit(0.0))).alias("_t"))
    g = g.crossJoin(F.broadcast(total))  # one row
    return g.withColumns({"difference": (F.col("VMT") - F.col("ref_vmt")) / F.nullif("ref_vmt", F.lit(0.0)) * 100, "material": (F.col("ref_vmt") >= 0.01 * F.col("_t")) & (F.col("VMT") > 0)}).drop("_t")


def miles_gate(groups: DataFrame) -> DataFrame:
    """R6: total difference (%), the greatest of a material group, PASS within 5 %."""
    a = groups.agg(((F.sum("VMT") - F.sum("ref_vmt")) / F.nullif(F.sum("ref_vmt"), F.lit(0.0)) * 100).alias("difference"), F.max(F.when(F.col("material"), F.abs("difference"))).alias("worst"))
    return a.withColumn("gate", F.when(F.col("difference").isNull(), "SKIP").when(F.abs("difference") <= 5, "PASS").otherwise("WARN"))


def stages(links: DataFrame, demand: DataFrame, hours: float, performance: DataFrame | None = None, declared_plf: bool = False) -> DataFrame:
    """stage, gate, said of R1 to R6; the last two are skipped without a run, the last without references."""
    spark = links.sparkSession
    r1, r2 = reverse_paired(links).first(), demand_by_class(demand).agg(F.count("*").alias("n"), F.sum("trips").alias("t")).first()
    r3, r4 = join_rate(links).first(), plf_gate(links, hours, declared_plf).first()
    rows = [
        ("01_inventory", "PASS" if r1["paired"] else "WARN", f"{r1['directed']} directed pairs, {r1['paired']} with a link back"),
        ("02_od_allowed_use", "PASS" if r2["n"] else "WARN", f"{r2['n']} classes, {r2['t'] or 0:.0f} trips"),
        ("03_capacity_join", r3["gate"], f"{r3['rate']:.1f} % complete"),
        ("04_plf_conversion", r4["gate"], f"flat: {r4['flat']}"),
    ]
    if performance is None:
        rows += [("05_consistency", "SKIP", "no run"), ("06_vmt_vht", "SKIP", "no run")]
        return fixed_stages(spark, rows)
    r5 = identities(performance).first()
    has_ref = "ref_volume" in performance.columns and not performance.filter("ref_volume > 0").isEmpty()
    slope = against_reference(performance).first()["slope"] if has_ref else None
    far = slope is not None and not 0.9 <= slope <= 1.1
    rows.append(("05_consistency", "FAIL" if r5["gate"] == "FAIL" else "WARN" if far else "PASS", "no reference" if slope is None else f"slope {slope:.3f}"))
    if has_ref:
        groups = performance.withColumns({"ref_vmt": F.col("ref_volume") * F.col("length"), "ref_vht": F.lit(0.0)})
        r6 = miles_gate(miles_by_group(groups, "link_type")).first()
        rows.append(("06_vmt_vht", r6["gate"], f"{r6['difference']:.2f} %, worst {r6['worst'] or 0:.2f} %"))
    else:
        rows.append(("06_vmt_vht", "SKIP", "no reference"))
    return fixed_stages(spark, rows)


def fixed_stages(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, STAGE)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small tables, at most ``most`` rows of each."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            out.append(f"\nThe first {most} rows.")
    return "\n".join(out) + "\n"


def page(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """The same as a page."""
    from html import escape

    out = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        out.append(f"<h2>{escape(name)}</h2><table border=1><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{'' if x is None else escape(str(x))}</td>" for x in r) + "</tr>" for r in df.limit(most).collect()]
        out.append("</table>")
    return "\n".join(out)


