"""Scenario edits and staged reports: routes, zone hierarchies, column repair, intake and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hourly lane capacities by facility, for links that have none.
FACILITY_CAPACITY = {"motorway": 2000.0, "trunk": 1900.0, "primary": 1500.0, "secondary": 1200.0, "tertiary": 1000.0}
OTHER_CAPACITY = 1000.0
# Column names that mean a canonical one.
ALIASES = {"allowed_uses": "allowed_use", "vdf_free_speed": "vdf_free_speed_mph", "vdf_cutoff_speed": "cutoff_speed", "ref_cost": "ref_time"}
GATES = ("PASS", "WARN", "SKIP", "FAIL")


def merge_routes(routes: DataFrame, shares: list[float]) -> DataFrame:
    """Routes of all iterations by link sequence: (mode, o, d, links, link_sum, share, volume).

    routes: mode, o, d, volume, iteration (from 0), links. Equal sequences add up. The
    sum of link ids, which may collide, is reported but not grouped by.
    """
    share = F.element_at(F.array(*[F.lit(float(x)) for x in shares]), (F.col("iteration") + 1).cast("int"))
    merged = routes.withColumn("share", share).groupBy("mode", "o", "d", "links").agg(F.first("volume").alias("q"), F.sum("share").alias("share"))
    return merged.select("mode", "o", "d", "links", F.aggregate("links", F.lit(0).cast("long"), lambda s, k: s + k).alias("link_sum"), "share", (F.col("q") * F.col("share")).alias("volume"))


def numbered_routes(routes: DataFrame, zones: int) -> tuple[DataFrame, DataFrame]:
    """(merged routes with route_id within their pair, link_id and background volume).

    In networks of 1000 zones or more the routes of pairs below one trip are not listed; their volume is
    the background of the links. routes: as ``merge_routes`` returns them.
    """
    w = Window.partitionBy("mode", "o", "d").orderBy(F.desc("share"), "links")
    all_ = routes.withColumn("route_id", F.row_number().over(w))
    total = F.sum("volume").over(Window.partitionBy("mode", "o", "d"))
    all_ = all_.withColumn("_q", total)
    small = F.lit(zones >= 1000) & (F.col("_q") < 1)
    back = all_.filter(small).select(F.explode("links").alias("link_id"), "volume").groupBy("link_id").agg(F.sum("volume").alias("background_volume"))
    return all_.filter(~small).drop("_q"), back


def od_report(pairs: DataFrame, nodes: DataFrame, zones: int) -> DataFrame:
    """Per pair with a path: miles, minutes, straight miles, their ratio (1 below a thousandth of a mile), a line and a map link.

    The line is given in networks below 300 zones or for 10 trips and more, the link above 10 trips. pairs:
    mode, o, d, volume, cost, links, miles; nodes: node_id, x, y.
    """
    from .reports import haversine_miles, map_url, wkt_line

    end = lambda k, c: F.broadcast(nodes.select(F.col("node_id").alias(c), F.col("x").cast("double").alias(f"x{k}"), F.col("y").cast("double").alias(f"y{k}")))  # noqa: E731  a row a node
    p = pairs.filter("links IS NOT NULL").join(end(1, "o"), "o").join(end(2, "d"), "d")
    at = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    straight = haversine_miles(*at)
    line = F.when(F.lit(zones < 300) | (F.col("volume") >= 10), wkt_line(*at)).otherwise("")
    return p.select("mode", "o", "d", "volume", "miles", F.col("cost").alias("minutes"), straight.alias("straight_miles"), F.when(straight < 0.001, 1.0).otherwise(F.col("miles") / straight).alias("ratio"), line.alias("geometry"), F.when(F.col("volume") > 10, map_url(*at)).otherwise("").alias("map_url"))


def canonical_names(df: DataFrame) -> DataFrame:
    """Lower-case names with aliases resolved; of names that become one the first stays."""
    seen, keep = set(), []
    for c in df.columns:
        name = ALIASES.get(c.strip().lower(), c.strip().lower())
        if name not in seen:
            seen.add(name)
            keep.append(F.col(f"`{c}`").alias(name))
    return df.select(*keep)


def repair_capacity(lanes: Column, capacity: Column, facility: Column) -> tuple[Column, Column]:
    table = F.create_map(*[F.lit(x) for kv in FACILITY_CAPACITY.items() for x in kv])
    return F.when(lanes <= 0, 1).otherwise(lanes), F.when(capacity <= 0, F.coalesce(F.try_element_at(table, F.lower(F.trim(facility))), F.lit(OTHER_CAPACITY))).otherwise(capacity)


def hierarchy(nodes: DataFrame, links: DataFrame, demand: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, demand) with representatives as new centroids 1..S before the old nodes.

    Connectors between a centroid and its members cost nothing, so one zone a centroid gives the
    flows of the network as it was. mapping: zone_id, rep_id.
    """
    reps = mapping.select("rep_id").distinct()
    number = reps.select("rep_id", F.row_number().over(Window.orderBy("rep_id")).cast("long").alias("super"))  # zones only
    s = reps.count()
    members = mapping.join(F.broadcast(number), "rep_id").select("zone_id", "super")
    order = nodes.select("node_id", "x", "y", (F.row_number().over(Window.orderBy("node_id")) + s).cast("long").alias("new_id"))
    place = number.join(nodes, number.rep_id == nodes.node_id).select(F.col("super").alias("node_id"), F.col("super").alias("zone_id"), "x", "y")
    out_nodes = place.unionByName(order.select(F.col("new_id").alias("node_id"), F.lit(0).cast("long").alias("zone_id"), "x", "y"))
    ids = F.broadcast(order.select("node_id", "new_id"))
    moved = links
    for end in ("from_node_id", "to_node_id"):
        moved = moved.join(ids, moved[end] == ids.node_id).drop(end, "node_id").withColumnRenamed("new_id", end)
    spokes = members.join(order.select(F.col("node_id").alias("zone_id"), "new_id"), "zone_id")
    both = spokes.select(F.col("super").alias("from_node_id"), F.col("new_id").alias("to_node_id")).unionByName(spokes.select(F.col("new_id").alias("from_node_id"), F.col("super").alias("to_node_id")))
    free = {"link_id": 900_000_000 + F.col("from_node_id") * 10_000 + F.col("to_node_id"), "lanes": F.lit(99), "capacity": F.lit(99_999.0), "length": F.lit(0.0), "free_speed": F.lit(60.0), "fftt": F.lit(0.0), "vdf_type": F.lit(0), "alpha": F.lit(0.0), "beta": F.lit(1.0), "plf": F.lit(1.0), "toll": F.lit(0.0), "allowed_use": F.lit("all"), "cost": F.lit(0)}
    kinds = dict(links.dtypes)
    spoke_links = both.select(*[(F.col(c) if c in ("from_node_id", "to_node_id") else free.get(c, F.lit(None)).cast(kinds[c])).alias(c) for c in links.columns])
    m = F.broadcast(members)
    od = demand.join(m.select(F.col("zone_id").alias("o"), F.col("super").alias("so")), "o").join(m.select(F.col("zone_id").alias("d"), F.col("super").alias("sd")), "d").filter("so <> sd")
    return out_nodes, moved.select(*links.columns).unionByName(spoke_links), od.groupBy("mode", F.col("so").alias("o"), F.col("sd").alias("d")).agg(F.sum("volume").alias("volume"))


def wide_to_long(matrix: DataFrame, origin: str, cores: dict[str, str]) -> DataFrame:
    """(mode, o, d, volume) from a matrix with a column a destination; zeros dropped. cores: column of core -> class."""
    dest = [c for c in matrix.columns if c not in (origin, "core")]
    long = matrix.unpivot([origin, "core"], dest, "d", "volume")
    names = F.create_map(*[F.lit(x) for kv in cores.items() for x in kv])
    return long.withColumn("mode", names[F.col("core")]).groupBy("mode", F.col(origin).alias("o"), F.col("d").cast("long").alias("d")).agg(F.sum("volume").alias("volume")).filter("volume > 0 AND mode IS NOT NULL")


def declared(lines: DataFrame) -> DataFrame:
    """(key, value) of ``key: value`` lines; comments, blanks and placeholders are not declared."""
    parts = F.split(F.regexp_replace("value", r"#.*$", ""), ":", 2)
    rows = lines.select(F.trim(parts[0]).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("v"))
    return rows.filter("key <> '' AND v IS NOT NULL AND v <> '' AND upper(v) NOT IN ('TODO', 'TBD', 'UNKNOWN', '?')").select("key", F.col("v").alias("value"))


def evidence(links: DataFrame, hours: float = 1.0) -> DataFrame:
    """(severity, code): what the data themselves say against common declarations."""
    a = links.agg(F.percentile("length", F.lit(0.5)).alias("len"), F.percentile(F.col("volume") / F.col("capacity") / F.col("lanes") / hours, F.lit(0.5)).alias("vc"), F.countDistinct("plf").alias("plfs"), F.max(F.when(F.col("capacity") < 90_000, F.col("capacity"))).alias("cap"))
    say = F.array(F.when(F.col("len") > 100, F.struct(F.lit("BLOCKER").alias("severity"), F.lit("length_in_metres").alias("code"))), F.when(F.col("cap") > 10_000, F.struct(F.lit("BLOCKER").alias("severity"), F.lit("daily_capacity").alias("code"))), F.when(F.col("vc") < 0.05, F.struct(F.lit("DECISION").alias("severity"), F.lit("empty_network").alias("code"))), F.when(F.col("plfs") <= 1, F.struct(F.lit("DECISION").alias("severity"), F.lit("flat_plf").alias("code"))))
    return a.select(F.explode(F.filter(say, lambda x: x.isNotNull())).alias("f")).select("f.*")


def worst_gate(stages: DataFrame) -> DataFrame:
    """The worst of all gates: PASS < WARN < SKIP < FAIL. stages: gate."""
    rank = F.array_position(F.array(*[F.lit(g) for g in GATES]), F.col("gate"))
    return stages.agg(F.element_at(F.array(*[F.lit(g) for g in GATES]), F.max(rank).cast("int")).alias("gate"))


def zone_clusters(zones: DataFrame, k: int, weight: str | None = None, seed: int = 7) -> DataFrame:
    """zone_id, cluster by k-means over x, y (weighted by ``weight``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["x", "y"], outputCol="at").transform(zones.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}))
    model = KMeans(k=k, seed=seed, featuresCol="at", predictionCol="cluster")
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(data).transform(data).select("zone_id", "cluster")


def _matrix(demand: DataFrame):
    """(row matrix of origins by destinations, origins in its order, sum of squares); rows stay distributed."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    cells = demand.groupBy("o", "d").agg(F.sum("volume").alias("v")).filter("v <> 0")
    ids = sorted(r[0] for r in cells.select("d").distinct().collect())  # zones
    rows_ = sorted(r[0] for r in cells.select("o").distinct().collect())
    place, line = {z: i for i, z in enumerate(ids)}, {z: i for i, z in enumerate(rows_)}
    per = cells.groupBy("o").agg(F.collect_list(F.struct("d", "v")).alias("row"))
    rows = per.rdd.map(lambda r: IndexedRow(line[r["o"]], Vectors.sparse(len(ids), {place[x["d"]]: float(x["v"]) for x in r["row"]})))
    total = cells.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    return IndexedRowMatrix(rows, len(rows_), max(1, len(ids))), rows_, total


def rank_energy(demand: DataFrame, levels: tuple = (0.5, 0.9, 0.99)) -> DataFrame:
    """(level, rank): how many singular values hold that part of the matrix's energy.

    As many singular values as the last level needs, twice as many a try; the matrix is not collected.
    """
    matrix, origins, total = _matrix(demand)
    most, k, part = matrix.numCols(), 8, []
    while total and (not part or (part[-1] < max(levels) and len(part) < most)):
        k = min(most, 2 * k)
        held = 0.0
        part = [held := held + float(x) ** 2 / total for x in matrix.computeSVD(k, computeU=False).s]
        if k == most:
            break
    return demand.sparkSession.createDataFrame([(float(x), next((i + 1 for i, p in enumerate(part) if p >= x - 1e-12), len(part))) for x in levels], "level double, rank int")


def od_embedding(demand: DataFrame, rank: int = 24) -> DataFrame:
    """zone_id, features: origins by the main destination patterns, rows of length 1."""
    matrix, origins, _ = _matrix(demand)
    svd = matrix.computeSVD(min(rank, matrix.numCols()), computeU=True)
    s = [float(x) for x in svd.s]

    def row(r):
        v = [float(x) * y for x, y in zip(r.vector.toArray(), s, strict=True)]
        n = sum(x * x for x in v) ** 0.5 + 1e-9
        return origins[r.index], [x / n for x in v]

    return demand.sparkSession.createDataFrame(svd.U.rows.map(row), "zone_id long, features array<double>")


def pattern_clusters(demand: DataFrame, k: int, rank: int = 24, seed: int = 7) -> DataFrame:
    """zone_id, cluster by k-means over ``od_embedding``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = od_embedding(demand, rank).select("zone_id", array_to_vector("features").alias("at"))
    return KMeans(k=k, seed=seed, featuresCol="at", predictionCol="cluster").fit(data).transform(data).select("zone_id", "cluster")


def demand_weights(zones: DataFrame, demand: DataFrame) -> DataFrame:
    """zones with ``weight``: trips that begin or end there, a little for the others."""
    ends = demand.select(F.explode(F.array("o", "d")).alias("zone_id"), "volume").groupBy("zone_id").agg(F.sum("volume").alias("w"))
    return zones.join(ends, "zone_id", "left").withColumn("weight", F.coalesce("w", F.lit(0.0)) + 1e-6).drop("w")


def manifest(spark, paths: list[str]) -> DataFrame:
    """(file, bytes, sha256, rows, columns) of CSV files; rows below the head that aren't blank."""
    lines = F.filter(F.split(F.col("content").cast("string"), r"\r?\n"), lambda x: F.trim(x) != "")
    head = F.transform(F.split(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), "^\ufeff", ""), ","), lambda x: F.trim(x))
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.greatest(F.size(lines) - 1, F.lit(0)).alias("rows"), head.alias("columns"))


def renumbered(links: DataFrame, demand: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, demand) with the ids of ``numbers`` (node_id, new_id); rows with ids that it doesn't hold are left out."""
    ids = F.broadcast(numbers.select("node_id", "new_id"))  # a row a node
    swap = lambda df, c: df.join(ids, df[c] == ids.node_id).withColumn(c, F.col("new_id")).drop("node_id", "new_id")
    out = swap(swap(links, "from_node_id"), "to_node_id").select(*links.columns)
    return out, swap(swap(demand, "o"), "d").select(*demand.columns)


def period_columns(df: DataFrame, period: int) -> DataFrame:
    """``NAME<period>`` columns as ``NAME``, those of other periods dropped."""
    import re

    keep = []
    for c in df.columns:
        m = re.fullmatch(r"(VDF_\w+?)(\d+)", c)
        if not m:
            keep.append(F.col(c))
        elif int(m[2]) == period:
            keep.append(F.col(c).alias(m[1].lower()))
    return df.select(*keep)


def period_hours(start: float, end: float) -> float:
    """Length of a period, over midnight if it must be."""
    return end - start if end > start else end + 24 - start


def lane_capacity(period_capacity: Column, lanes: Column, hours: float) -> Column:
    return period_capacity / F.greatest(lanes, F.lit(1)) / hours
