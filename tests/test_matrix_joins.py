"""Hashes of a large matrix do not pass through the driver, whatever their plan is estimated at."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["h4_config_hash", "h6_pending", "h6_progress", "h7_first_pending"])
def test_matrices_meet_by_shuffle(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
