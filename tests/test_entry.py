import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# 15 nodes at the smaller scale, where sets are enumerated; the SQL of these queries draws them.
DRAWN = {
    "random_sets", "random_sets_shared", "explode_sets", "set_members", "random_set_mean", "simulated_lisa",
    "rank_position", "spatial_lisa_mc", "spatial_lisa_mc_shared", "spatial_lisa_mc_whole",
    "temporal_mc_local", "temporal_mc_global", "tuple_sets", "stream_lisa_mc", "expected_positions",
    "stream_temporal_mc_local", "stream_temporal_mc_global", "stored_positions",
}
# Queries of the optional subpackage have tests of their own.
QUERIES = sorted(n for n in entry.queries() if not re.fullmatch(r"op\d+_\w+|pipeline", n))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def cons():
    return {sf: connection(sf) for sf in (SF, LARGER)}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 394


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, cons, name):
    sf = LARGER if name in DRAWN else SF
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, cons[sf].execute(entry.oracle_sql()[name]).df()) is None
