"""Every registered query of the engine runs; those with SQL give the same rows."""

from __future__ import annotations

import pytest
from sqlcheck import compare, connect

from gridquorum.queries import QUERIES, SQL, entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        # vas_mean and bootstrap_ratio draw by hash or chance: tests/test_values.py checks them
        assert df.count() == 1 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry(spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_linenumber = 1").select("l_suppkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)]" in plan
    plan = QUERIES["extent"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
