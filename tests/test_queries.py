"""Every query of the library against its SQL; those without SQL must run and keep their columns."""

import pytest

from tessera.plans import registry
from tests.oracle import SMALL, duck, rows_of_duck, rows_of_spark

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = rows_of_spark(QUERIES[name](spark, SMALL))
    if name in SQL:
        assert found == rows_of_duck(con, SQL[name])
    else:
        assert found[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
