"""Every registered query against its SQL, on the smallest tables."""

import pytest

from gridspan.suite import ORACLES, QUERIES
from tests.oracle import compare, database


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


# needs more orders than the smallest tables hold
LARGER = {"O5_sample"}


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in LARGER])
def test_same_rows_as_sql(spark, sf, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["value", "count", "fraction"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
