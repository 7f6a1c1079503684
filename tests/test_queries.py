"""Every query with SQL gives the rows that the other engine gives; the others give rows."""

import math

import duckdb
import pytest

from tidewater import registry
from tidewater.plans.query import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def other():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "quantize"):
        return plain(float(v))
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, other, name):
    df = registry.QUERIES[name](spark, SF)
    found = other.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
