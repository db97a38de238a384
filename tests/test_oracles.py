"""Every engine query against its SQL, on the whole table."""

from __future__ import annotations

import pytest

from tessera import queries

from .oracle import connect, same


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
