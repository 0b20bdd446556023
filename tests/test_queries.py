"""Every query of the library proper: against its SQL where there is one, else that it gives rows, and the same again."""

import pytest

from oracle import compare
from textloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), SQL[name], folder) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    """Queries without SQL give rows, the same ones again; what they hold is tested beside their operators."""
    df = QUERIES[name](spark, folder)
    rows = sorted(map(str, df.collect()))
    assert rows and rows == sorted(map(str, QUERIES[name](spark, folder).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
