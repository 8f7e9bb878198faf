"""Properties of physical plans that matter at scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry_points.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["volume_ranking", "clean_sales", "monthly_sales", "rolling_price", "percentile_scores", "representatives", "contract_log_join", "snapped_areas", "rent_panel", "legend_values_split", "region_dimensions"])
def test_no_pairwise_joins_and_no_python_rows(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_cleaning_needs_no_shuffle(spark):
    assert "Exchange hashpartitioning" not in plan(spark, "clean_sales")


def test_panel_windows_share_one_shuffle(spark):
    assert plan(spark, "rolling_price").count("Exchange hashpartitioning(internal_complex_id") <= 1


def test_limits_are_planned_per_partition_first(spark):
    assert "TakeOrderedAndProject" in plan(spark, "volume_ranking") and "WindowGroupLimit" in plan(spark, "representatives")
