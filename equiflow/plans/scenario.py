"""A traffic scenario derived from the benchmark tables with integer arithmetic, in SQL.

Nations are the zones of a 5 x 5 grid, customer segments the vehicle classes, and ordered
quantities from supplier to customer nation the trips. A second network (``g...``) grows with the
tables: a square grid with as many nodes as there are suppliers, and trips from suppliers to customers.
The text runs in Spark and in DuckDB; ``@table`` stands for an input table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TOTAL_TRIPS = 60_000

CTES = {
    "node": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS node_id, CAST(n_nationkey + 1 AS BIGINT) AS zone_id,
        CAST(n_nationkey % 5 AS BIGINT) AS x, CAST(floor(n_nationkey / 5) AS BIGINT) AS y FROM @nation""",
    "pair": """SELECT a.node_id AS f, b.node_id AS t FROM node a JOIN node b ON abs(a.x - b.x) + abs(a.y - b.y) = 1""",
    "link": """SELECT f * 100 + t AS link_id, f AS from_node_id, t AS to_node_id, 1 + (f + t) % 3 AS lanes,
        CAST(400 + 50 * ((f * 7 + t * 3) % 9) AS DOUBLE) AS capacity, 1 + 0.25e0 * ((f * 5 + t * 11) % 8) AS length,
        CAST(30 + 5 * ((f + 2 * t) % 5) AS DOUBLE) AS free_speed, (1 + 0.25e0 * ((f * 5 + t * 11) % 8)) / (30 + 5 * ((f + 2 * t) % 5)) * 60 AS fftt,
        (f * 3 + t) % 7 AS vdf_type, 0.15e0 + 0.05e0 * ((f + t) % 3) AS alpha, CAST(2 + (f * t) % 4 AS DOUBLE) AS beta,
        CASE WHEN (f + t) % 4 = 0 THEN 0.9e0 ELSE 1e0 END AS plf, CASE WHEN (f + t) % 5 = 0 THEN 0.5e0 ELSE 0e0 END AS toll,
        CASE (f * 13 + t * 7) % 11 WHEN 0 THEN 'AUTOMOBILE;BUILDING' WHEN 1 THEN 'closed' WHEN 2 THEN 'HOUSEHOLD' WHEN 3 THEN '' ELSE 'all' END AS allowed_use,
        1 + (f + t) % 4 AS link_type, (f * 2 + t) % 3 AS area_type, CAST(200 + (f * 37 + t * 53) % 2400 AS DOUBLE) AS volume,
        CAST(150 + (f * 41 + t * 59) % 2400 AS DOUBLE) AS ref_volume,
        CAST(round((1 + 0.25e0 * ((f * 5 + t * 11) % 8)) / (30 + 5 * ((f + 2 * t) % 5)) * 60 * 10000) AS BIGINT) * 1000 + (f * 31 + t * 17 + f * t) % 97 AS cost FROM pair""",
    "mode": """SELECT m AS mode, CAST(8 + 4 * k AS DOUBLE) AS vot, CASE WHEN k = 4 THEN 2e0 ELSE 1e0 END AS pce, CAST(1 + k % 3 AS DOUBLE) AS occ, 0.1e0 * k AS operating_cost, k
        FROM (SELECT c_mktsegment AS m, row_number() OVER (ORDER BY c_mktsegment) AS k FROM (SELECT DISTINCT c_mktsegment FROM @customer) s) r""",
    "od": """SELECT c_mktsegment AS mode, CAST(s_nationkey + 1 AS BIGINT) AS o, CAST(c_nationkey + 1 AS BIGINT) AS d, CAST(sum(l_quantity) AS BIGINT) AS q
        FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN @customer ON o_custkey = c_custkey JOIN @supplier ON l_suppkey = s_suppkey
        GROUP BY c_mktsegment, s_nationkey, c_nationkey""",
    "demand": f"""SELECT mode, o, d, CAST(floor(CAST(q AS DOUBLE) * {TOTAL_TRIPS} / (SELECT CAST(sum(q) AS DOUBLE) FROM od)) AS DOUBLE) AS volume FROM od""",
    "gside": "SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS s FROM @supplier",
    "gnode": """SELECT a.k * s + b.k + 1 AS node_id, a.k * s + b.k + 1 AS zone_id, b.k AS x, a.k AS y, s
        FROM (SELECT CAST(s_suppkey - (SELECT min(s_suppkey) FROM @supplier) AS BIGINT) AS k FROM @supplier) a, (SELECT CAST(s_suppkey - (SELECT min(s_suppkey) FROM @supplier) AS BIGINT) AS k FROM @supplier) b, gside WHERE a.k < s AND b.k < s""",
    "gpair": """SELECT a.node_id AS f, b.node_id AS t FROM gnode a JOIN gnode b ON b.node_id = a.node_id + a.s AND b.x = a.x
        UNION ALL SELECT b.node_id, a.node_id FROM gnode a JOIN gnode b ON b.node_id = a.node_id + a.s AND b.x = a.x
        UNION ALL SELECT a.node_id, b.node_id FROM gnode a JOIN gnode b ON b.node_id = a.node_id + 1 AND b.y = a.y
        UNION ALL SELECT b.node_id, a.node_id FROM gnode a JOIN gnode b ON b.node_id = a.node_id + 1 AND b.y = a.y""",
    "glink": """SELECT f * 1000000 + t AS link_id, f AS from_node_id, t AS to_node_id, 1 + (f + t) % 3 AS lanes,
        CAST(800 + 50 * ((f * 7 + t * 3) % 9) AS DOUBLE) AS capacity, 1 + 0.25e0 * ((f * 5 + t * 11) % 8) AS length,
        CAST(30 + 5 * ((f + 2 * t) % 5) AS DOUBLE) AS free_speed, (1 + 0.25e0 * ((f * 5 + t * 11) % 8)) / (30 + 5 * ((f + 2 * t) % 5)) * 60 AS fftt,
        CAST(0 AS BIGINT) AS vdf_type, 0.15e0 AS alpha, 4e0 AS beta, 1e0 AS plf, 0e0 AS toll, 'all' AS allowed_use,
        CAST(round((1 + 0.25e0 * ((f * 5 + t * 11) % 8)) / (30 + 5 * ((f + 2 * t) % 5)) * 60 * 10000) AS BIGINT) * 10000000 + (f * 7919 + t * 104729 + f * t * 31) % 999983 AS cost FROM gpair""",
    "gdemand": """SELECT c_mktsegment AS mode, CAST(l_suppkey % (s * s) + 1 AS BIGINT) AS o, CAST(o_custkey * 13 % (s * s) + 1 AS BIGINT) AS d, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS volume
        FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN @customer ON o_custkey = c_custkey, gside GROUP BY 1, 2, 3""",
}
NEEDS = {"gside": [], "gnode": ["gside"], "gpair": ["gside", "gnode"], "glink": ["gside", "gnode", "gpair"], "gdemand": ["gside"], "node": [], "pair": ["node"], "link": ["node", "pair"], "mode": [], "od": [], "demand": ["od"]}


def with_ctes(*names: str, recursive: bool = False) -> str:
    """``WITH ...`` for DuckDB; ends where a query or a comma and more can follow."""
    order = [n for n in CTES if n in {x for name in names for x in [name, *NEEDS[name]]}]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({re.sub('@', '', CTES[n])})" for n in order)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    order = [n for n in CTES if n in {name, *NEEDS[name]}]
    text = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    text = re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text)
    return spark.sql(f"WITH {text} SELECT * FROM {name}")
