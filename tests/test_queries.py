"""Every query with a statement, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from stepwell.plans import registry

from .oracle import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(con, registry.QUERIES[name](spark, SF), registry.ORACLE[name]) == ""


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
