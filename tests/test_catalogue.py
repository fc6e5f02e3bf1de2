"""Every registered traffic query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from equiflow import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, db, name):
    got = rows(catalogue.QUERIES[name](spark, SF).toPandas())
    if name in catalogue.ORACLES:
        want = rows(db.execute(catalogue.ORACLES[name]).df())
        assert list(got.columns) == list(want.columns) and len(got) == len(want)
        for c in got.columns:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_paths_are_unique(spark, db):
    """No pair has two cheapest paths, so loading is well defined."""
    cost = {(r.o, r.d): r.cost for r in catalogue.QUERIES["sssp_freeflow"](spark, SF).collect()}
    link = catalogue.links(spark, SF).select("from_node_id", "to_node_id", "cost").collect()
    for (o, d), c in cost.items():
        assert o == d or sum(cost[o, r.from_node_id] + r.cost == c for r in link if r.to_node_id == d) == 1


def test_simulation_has_all_vehicles(spark):
    """The registered job simulates every trip of every reachable pair, and enough of them that links queue."""
    pairs = catalogue.loaded(spark, SF)[1].filter("links IS NOT NULL").collect()
    got = catalogue.QUERIES["simulate"](spark, SF).toPandas()
    assert len(got) == sum(r.volume for r in pairs) and got.agent_id.nunique() == len(got)  # volumes are whole here
    free = {r.link_id: int(max(1, r.fftt * 10)) / 10 for r in catalogue.links(spark, SF).collect()}
    late = (got.arrival_minute - got.departure_minute).dropna()
    assert late.max() > 2 * max(sum(free[k] for k in r.links) for r in pairs)
