"""Plan rules over the registered queries: no nested-loop or cartesian joins, no Python in the data path."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
# queries that fit models or write tables while they are built are left to the other suites
LAZY = sorted(k for k in QUERIES if k[0] not in "LP" and not k.startswith(("A", "S1_upsert_table")))


@pytest.mark.parametrize("key", LAZY)
def test_plan_has_no_pairwise_join_and_no_python(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_scans_are_pruned_and_filters_pushed(spark):
    from cellseason.plans.bindings import Views

    v = Views(spark, SF)
    plan = v.rain._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    plan = v.table("orders").filter("o_orderkey < 5").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,5)]" in plan
