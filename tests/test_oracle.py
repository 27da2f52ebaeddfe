"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from flowloom.plans import catalog

ORACLE = entry.oracle_sql()
WITHOUT_SQL = {"forest_baseline", "forest_importances", "boosted_baseline", "sanity_check"}


@pytest.fixture(scope="module")
def con(sf):
    return compare.connection(sf)


def test_registry():
    # Queries of the optional subpackage have their own tests.
    assert set(catalog.ORACLE) | WITHOUT_SQL == set(catalog.QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, sf, name):
    difference, _, _ = compare.check(spark, con, entry.queries()[name], ORACLE[name], sf)
    assert difference is None


def test_entry(spark):
    assert entry.entry(spark).count() == 173
