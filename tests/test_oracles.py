"""Every query that has SQL against that SQL, and the others for rows, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from riskloom.plans import queries


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert compare.differences(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
