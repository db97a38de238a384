"""The registered queries against their SQL, on whole tables."""

from __future__ import annotations

import pytest

from tessera.llm import queries

from ..oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    same(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).sql(queries.ORACLE_SQL[name]).df())
