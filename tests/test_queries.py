"""Every query has an SQL twin, and gives DuckDB's rows."""

import pytest

from pennyweight.plans import catalogue

from .compare import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
