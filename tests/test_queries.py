"""Every registered query against its SQL on a second engine, and against nothing but itself where it has none."""

import pytest

import __spark_entry__ as contract
from checks import compare, registry


@pytest.fixture(scope="module")
def duck(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    assert compare.differences(df, duck, registry.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["pre_level", "post_level", "record_cnt"] and df.count() > 0
