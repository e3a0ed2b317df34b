"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from tabloom.catalog.oracles import ORACLES
from tabloom.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, folder, connection, name):
    assert difference(QUERIES[name](spark, folder), connection.sql(ORACLES[name])) is None
