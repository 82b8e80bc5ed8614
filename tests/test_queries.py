"""Every core query with SQL agrees with it on the smallest tables; the others give rows."""

import pytest

from conftest import SF, rows_of
from quireflow import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(name, spark, sql):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), sql(catalog.SQL[name])
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
