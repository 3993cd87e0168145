"""Every catalog query runs, and equals its SQL where it has one."""

from __future__ import annotations

import pytest

from boresight.plans import catalog
from tests.oracle import database, spark_rows, sql_rows

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    assert names and (rows or name in ORACLES)
    if name in ORACLES:
        wanted_names, wanted = sql_rows(database(sf), ORACLES[name])
        assert names == wanted_names
        assert rows == wanted


def test_no_oracle_without_query():
    assert ORACLES.keys() <= QUERIES.keys()
