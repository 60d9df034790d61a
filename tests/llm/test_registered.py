"""The registered queries of the numbered operators: SQL where there is some, names, cleaning up."""

from __future__ import annotations

import re

import pytest
from oracle import compare, connect

from tessera.llm import queries
from tessera.llm.common import forget, materialized


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    compare(connect(sf), queries.queries()[name](spark, sf), queries.oracle_sql()[name])


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 14))


def test_forget(spark):
    df = materialized(spark.range(5))
    assert df.count() == 5 and forget(spark) > 0 and forget(spark) == 0
