"""Plan guards: no registered query plans a cross join or a nested-loop join,
and the analytics stay in the JVM (no Python UDF evaluation in their plans)."""
import pytest

from penalytics.plans.registry import all_queries
from tests.conftest import SF_SMALL

ORACLE = sorted(n for n, q in all_queries().items() if q.oracle is not None)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    df.collect()  # AQE final plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ORACLE)
def test_no_cross_join_no_python_udf(spark, name):
    plan = _plan(all_queries()[name].build(spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


def test_scans_are_pruned(spark):
    from penalytics.sources.fixture import hrrp_raw
    plan = _plan(hrrp_raw(spark, SF_SMALL))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan
    assert "ReusedExchange" in plan  # national rates reuse the lineitem aggregation
