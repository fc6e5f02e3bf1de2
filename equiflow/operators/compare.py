"""Comparisons: results against inputs and references, two runs, two skims, tables of expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import fit

ENDS = ["from_node_id", "to_node_id"]


def performance_of_links(performance: DataFrame, links: DataFrame, *columns: str) -> DataFrame:
    """performance with ``columns`` of links, joined by their ends; of links with the same ends the one with the greatest id counts."""
    last = links.groupBy(*ENDS).agg(F.max_by(F.struct(*columns), "link_id").alias("_l"))
    return performance.join(last, ENDS, "left").select(*performance.columns, *[F.col("_l")[c].alias(c) for c in columns])


def performance_of_ids(performance: DataFrame, links: DataFrame, *columns: str) -> DataFrame:
    """performance with ``columns`` of links, joined by link id."""
    return performance.join(links.select("link_id", *columns), "link_id")


def volumes_with_reference(assigned: DataFrame, reference: DataFrame, facility: str = "factype") -> DataFrame:
    """from, to, volume, ref_volume of links that both have; connectors (facility 0) are left out."""
    ref = reference.filter(F.col(facility) != 0).select(*ENDS, "ref_volume", facility)
    return assigned.select(*ENDS, "volume").join(ref, ENDS)


def two_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of links that two runs share: n, greatest change of volume, vehicle miles of each, fit."""
    both = a.select("link_id", "length", F.col("volume").alias("va")).join(b.select("link_id", F.col("volume").alias("vb")), "link_id")
    f = fit(both, "va", "vb")
    more = both.agg(F.max(F.abs(F.col("va") - F.col("vb"))).alias("max_delta"), F.sum(F.col("va") * F.col("length")).alias("vmt_a"), F.sum(F.col("vb") * F.col("length")).alias("vmt_b"))
    return f.crossJoin(more)  # one row each


def two_skims(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over the pairs (o, d, cost) in both: pairs, r2 of b as a prediction of a, mean absolute difference."""
    both = a.select("o", "d", F.col("cost").alias("a")).join(b.select("o", "d", F.col("cost").alias("b")), ["o", "d"])
    s = both.agg(F.count("*").alias("pairs"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("rest"), (F.var_pop("a") * F.count("*")).alias("all"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_difference"))
    return s.select("pairs", (1 - F.col("rest") / F.nullif("all", F.lit(0.0))).alias("r2"), "mean_difference")


def benchmark(links: DataFrame, expected: DataFrame, value: Column, tolerance: Column) -> DataFrame:
    """Per (facility, area): median of value, the expected one, and whether it is within the tolerance.

    expected: facility, area, expected; groups that it doesn't hold are left out.
    """
    medians = links.groupBy("facility", "area").agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count("*").alias("links"))
    return medians.join(F.broadcast(expected), ["facility", "area"]).withColumn("within", F.abs(F.col("median") - F.col("expected")) <= tolerance)


def share_within(benchmarked: DataFrame) -> DataFrame:
    return benchmarked.agg(F.count("*").alias("groups"), F.sum(F.col("within").cast("long")).alias("within"), F.avg(F.col("within").cast("double")).alias("share"))


def band(links: DataFrame, volume: str = "volume", ref: str = "ref_volume", width: float = 0.1) -> DataFrame:
    """One row: share of links within the band, volume on closed links, ratio of the sums, mean difference."""
    v, r = F.col(volume), F.col(ref)
    return links.agg(F.avg((F.abs(v - r) <= width * r).cast("double")).alias("within"), F.sum(F.when(F.lower(F.trim("allowed_use")) == "closed", v).otherwise(0.0)).alias("closed_leak"), (F.sum(v) / F.sum(r)).alias("ratio"), F.avg(v - r).alias("bias"))


def convergence(runs: DataFrame) -> DataFrame:
    """Per run in order of its iterations: vehicle miles, and greatest change of a link's volume from the run before.

    runs: iterations, link_id, volume, length.
    """
    from pyspark.sql import Window

    before = F.lag("volume").over(Window.partitionBy("link_id").orderBy("iterations"))
    return runs.withColumn("_d", F.abs(F.col("volume") - before)).groupBy("iterations").agg(F.sum(F.col("volume") * F.col("length")).alias("vmt"), F.max("_d").alias("max_delta"))


def fit_of_counts(df: DataFrame, volume: str = "volume", obs: str = "obs") -> DataFrame:
    """One row over links with a count above 1: n, 1 - SSE / SST, squared correlation, RMSE, sums."""
    used = df.filter(F.col(obs) > 1)
    v, o = F.col(volume), F.col(obs)
    return used.agg(F.count("*").alias("n"), (1 - F.sum((v - o) * (v - o)) / F.nullif(F.var_pop(obs) * F.count("*"), F.lit(0.0))).alias("r2"), (F.corr(volume, obs) * F.corr(volume, obs)).alias("correlation2"), F.sqrt(F.avg((v - o) * (v - o))).alias("rmse"), F.sum(v).alias("sum_volume"), F.sum(o).alias("sum_obs"))
