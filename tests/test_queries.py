"""Every registered query at the smallest scale: against its SQL in DuckDB where there is one."""

import pytest

import __spark_entry__ as spark_entry
from check import compare, connect, types_differ

SF = "/root/testdata/sf0.001"
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = spark_entry.queries()[name](spark, SF)
    relation = duck.sql(ORACLES[name])
    assert types_differ(df, relation) == ""
    assert compare(df.toPandas(), relation.df()) == ""


@pytest.mark.parametrize("name", sorted(set(spark_entry.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert spark_entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
