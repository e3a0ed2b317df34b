"""The queries that have SQL against it on the smallest tables, and all of them for their columns."""

import pytest

from compare import connect, difference
from tabloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder).sql(ORACLES[name])) is None


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
