"""Every registered query against its SQL; those without SQL have to give rows of a stable shape."""

import pytest

from quernstone.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_alone(name, spark, data):
    df = QUERIES[name](spark, data)
    assert df.columns == QUERIES[name](spark, data).columns
    assert df.count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
