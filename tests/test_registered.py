"""Every registered query against its SQL; queries without SQL must give rows of a stable schema."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_point
from conftest import SF

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert differences(found, database.execute(ORACLES[name]).df()) == ""
    else:
        assert len(found) > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
