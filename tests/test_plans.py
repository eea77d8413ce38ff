"""What the physical plans must not contain."""

import re

import pytest

import __spark_entry__ as entry_point
from tidemark.catalogue.registry import QUERIES
from tests.conftest import SF

# Streams are built by running them.
LAZY = sorted(name for name in QUERIES if not name.startswith(("stream_delta", "stream_top", "stream_mon", "stream_sl", "stream_live", "stream_late")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_plan(spark, name):
    plan = plan_of(entry_point.queries()[name](spark, SF))
    for operator in (
        "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"
    ):
        assert operator not in plan


def test_lag_never_takes_a_whole_key(spark, tables):
    """Neighbour operators window by key and stretch, so the wide rows of one key spread over many tasks."""
    plan = plan_of(entry_point.queries()["delta_raw"](spark, SF))
    wide = [line for line in plan.splitlines() if "windowspecdefinition" in line and "event_id" in line]
    assert wide and all("_chunk" in line for line in wide)


def test_top_n_per_group_cuts_before_the_shuffle(spark):
    plan = plan_of(entry_point.queries()["win_longest"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_day_filter_reaches_the_scan(spark):
    plan = plan_of(entry_point.queries()["flt_same_day"](spark, SF))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", plan)


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(entry_point.queries()["agg_having"](spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan


def test_gate_reads_each_table_once(spark, tables):
    import __spark_entry__ as entry_point
    from tests.conftest import SF

    plan = entry_point.queries()["cls_gate_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    once = sum(table._jdf.queryExecution().executedPlan().toString().count("FileScan") for table in (tables.segments, tables.objects))
    assert plan.count("FileScan") == once
