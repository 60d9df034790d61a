"""Every query of the library against its SQL; those without SQL give rows."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from tessera import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    compare(con, QUERIES[name](spark, sf), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
