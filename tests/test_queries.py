import pytest

from oracle import expected, rows
from veldspar.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert rows(df.collect(), df.columns) == expected(SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
