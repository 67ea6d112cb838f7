"""Plans keep filters and columns at the scan and never pair all rows."""

import pytest

from tidepoint import catalog

SF = "/root/testdata/sf0.001"
# Queries that run jobs while they are built have their own tests.
PLANNED = [
    "time_range", "group_by_time", "fill_null", "slimit", "limit_offset", "validate_points", "assign_slices", "project_chart",
    "verify_event_sequence", "latest_snapshot", "apply_settlements", "resolve_incidents", "recover_imports", "admit_once", "plan_restart",
]


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_time_range_reaches_the_scan(spark):
    plan = plan_of(spark, "time_range")
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairing_of_all_rows(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_aggregates_combine_before_the_shuffle(spark):
    plan = plan_of(spark, "group_by_time")
    assert plan.count("Exchange") == 1 and "partial_avg" in plan
