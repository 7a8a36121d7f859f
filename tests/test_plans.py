"""Physical plan properties every registered report must keep."""

from __future__ import annotations

import re

import pytest

from mercata.plans.registry import QUERIES

# MLlib k-means runs its own jobs while the plan is built.
EAGER = {"kmeans_elbow", "kmeans_segments", "kmeans_profile", "kmeans_profile_four", "cluster_sizes", "cluster_mean_bars", "kmeans_certificate", "kmeans_elbow_certificate"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_shape(spark, sf_dir, name):
    from mercata.plans.inspect import plan_summary

    df = QUERIES[name](spark, sf_dir)
    plan = _plan(df)
    summary = plan_summary(df)
    assert summary["cartesian"] == 0
    assert "BatchEvalPython" not in plan, "row-at-a-time Python UDF in plan"
    assert summary["python"] == 0
    assert summary["bnlj"] == 0, "nested-loop join in plan"


def test_scan_pruning_and_pushdown(spark, sf_dir):
    from mercata.sources.fixtures import retail_transactions

    plan = _plan(retail_transactions(spark, sf_dir))
    orders_scan = [l for l in plan.splitlines() if "FileScan parquet" in l and "o_orderdate" in l][0]
    assert "IsNotNull(o_orderkey)" in orders_scan and "LessThan" not in orders_scan  # every order
    assert "o_orderpriority" not in orders_scan and "o_totalprice" not in orders_scan


def test_not_in_is_an_equi_anti_join(spark, sf_dir):
    plan = _plan(QUERIES["daily_revenue"](spark, sf_dir))
    assert "LeftAnti" in plan
    assert not re.search(r"BroadcastNestedLoopJoin.*LeftAnti", plan)


def _copies(df) -> int:
    """Scalar subqueries of the logical plan, each mention counted."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery#")


@pytest.mark.parametrize("wide, long", [("cohort_matrix_wide", "cohort_matrix"), ("cohort_retention_wide", "cohort_retention_rate"),
                                        ("ab_day_mix_wide", "ab_day_mix"), ("ab_hour_mix_wide", "ab_hour_mix")])
def test_a_wide_form_reads_what_its_long_form_reads(spark, sf_dir, wide, long):
    scans = lambda name: _plan(QUERIES[name](spark, sf_dir)).count("FileScan")
    assert scans(wide) <= scans(long)


def test_a_total_is_asked_for_once(spark, sf_dir):
    # the share's total and the emptiness of the cancelled set, in both copies of the sales
    assert _copies(QUERIES["product_revenue_share"](spark, sf_dir)) <= 4
    assert _copies(QUERIES["rfm_standardize"](spark, sf_dir)) <= 2
