"""Every query against its DuckDB equivalent; those without one give rows."""

import pytest

from millrace.plans import catalog
from tests.conftest import SF

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert e.oracle_sql().keys() <= e.queries().keys()
