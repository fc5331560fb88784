"""Every query against its twin in SQL, on the smallest tables."""

import math

import duckdb
import pytest

from isotherm.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(row[c]) for c in cols)) for row in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in cols)) for row in found.fetchall())
    assert got == want


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_missing_chunks_cover_what_is_missing(spark):
    rows = QUERIES["missing_chunks"](spark, SF).collect()
    assert rows and all(r["north"] > r["south"] and r["east"] > r["west"] for r in rows)
    snow = [r for r in rows if r["variable"] == "snow"]
    assert len(snow) == 1 and snow[0]["hours_mask"] == (1 << 12) + (1 << 20)
