"""Every registered query with SQL gives the rows that SQL gives."""

import pytest

from bandweave import catalog

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows_of(got) == rows_of(want)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
