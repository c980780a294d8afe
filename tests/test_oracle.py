"""Every core query beside its SQL, on the smallest tables; queries without SQL must run and keep their schema."""

import pytest
from oracle_check import DATA, compare, connect

from tessera.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, "sf0.001", QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "chunk", "rank", "score"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
