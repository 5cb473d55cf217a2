"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from terrastrat.plans import registry

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SMALL)) == rows_of_sql(duck, SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows_and_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["block", "tp", "fp", "fn", "truth_n", "pred_n", "dti"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
