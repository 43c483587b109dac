"""Every named query against its SQL on the smallest tables."""

import pytest
from conftest import SF_DIR

import __spark_entry__ as entry_module
from compare import compare, duck_connection
from wafermill import catalog

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    problem = compare(spark, duck, SF_DIR, name)
    if problem == "empty result":  # nothing to compare in the smallest tables
        problem = compare(spark, duck_connection(LARGER), LARGER, name)
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 1


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry_module.queries())
