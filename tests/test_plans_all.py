"""Every registered query plans without cartesian products or nested-loop joins.

Slow (builds every query), so it runs only with TRAWL_PLAN_SCAN=1.
"""

import os

import pytest

import __spark_entry__ as ENTRY

pytestmark = pytest.mark.skipif(not os.environ.get("TRAWL_PLAN_SCAN"), reason="set TRAWL_PLAN_SCAN=1")

_NAMES = sorted(ENTRY.queries())


@pytest.mark.parametrize("name", _NAMES)
def test_no_cross_join(spark, sf0001, name):
    df = ENTRY.queries()[name](spark, sf0001)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
