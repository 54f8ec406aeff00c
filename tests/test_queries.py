"""Every query of the engine's own operators against its SQL."""

from __future__ import annotations

import pytest

from tests.compare import rows_of_duckdb, rows_of_spark
from wovenlake import catalog_queries


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query_equals_sql(spark, data, name):
    got = rows_of_spark(catalog_queries.QUERIES[name](spark, data))
    assert got == rows_of_duckdb(data, catalog_queries.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
