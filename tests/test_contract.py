"""The driver's contract: names, a flagship result, and parity of a few queries with DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    from marketweave.plans.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_features", "j3_asof", "z10_score", "a10_net_sharpe", "p3_rank_label"])
def test_parity(spark, name):
    from tools.parity import duck, same

    got = entry.queries()[name](spark, SMALL).toPandas()
    assert same(got, duck(SMALL).sql(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
