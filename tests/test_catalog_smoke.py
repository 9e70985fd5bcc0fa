"""Every registered query runs on the smallest landed tables and keeps a
stable schema; every query of the core catalog has an oracle."""

import pytest

import __spark_entry__ as E
from marketsig.plans.catalog import QUERIES
from marketsig.plans.oracle import ORACLE

SMALL = "/root/testdata/sf0.001"


def test_every_core_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "ticker" in df.columns


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs(spark, name):
    q = E.queries()[name]
    a = q(spark, SMALL)
    assert a.count() >= 0
    assert a.schema == q(spark, SMALL).schema
