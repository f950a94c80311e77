"""The registered queries: SQL and column names where both exist, at the smallest size."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tidemark.plans import oracle, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-3)
    return a == b


@pytest.mark.parametrize("name", ["bars_daily", "clean_stats", "rsi", "cs_percentile", "regime_segments", "universe_diff", "monthly_returns", "file_names", "business_day_counts", "stream_hourly_bars"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(oracle.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: [str(x) for x in r if not isinstance(x, float)]
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    want = sorted(cur.fetchall(), key=key)
    assert len(got) == len(want) and all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
