"""Bucketed fact tables: the same rows, without exchanges by order id."""

from __future__ import annotations

import pytest

from mercata.operators import delivery as dl
from mercata.operators import economics as ec
from mercata.sources import fixtures as fx
from mercata.sources.layout import bucket_by_order, open_bucketed


@pytest.fixture(scope="module")
def both(spark, sf_dir, tmp_path_factory):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on a cluster, where no fact table fits
    plain = fx.delivery_tables(spark, sf_dir, fx.DASHBOARD_PERIOD_DAYS)
    folder = str(tmp_path_factory.mktemp("buckets"))
    yield plain, bucket_by_order(plain, 4, "layout_test", folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for name in ("user_actions", "courier_actions", "orders"):
        spark.sql(f"DROP TABLE IF EXISTS layout_test_{name}")


def reports(spark, t):
    cancelled = dl.cancelled_orders(t.user_actions)
    model = ec.cost_model_frame(spark)
    return {
        "daily_core_metrics": dl.daily_core_metrics(t.user_actions, t.courier_actions, t.orders, cancelled=cancelled),
        "gross_profit": ec.gross_profit(t.user_actions, t.courier_actions, t.orders, t.products, t.reduced_vat_names, model, cancelled=cancelled),
        "daily_revenue": ec.daily_revenue(t.orders, t.user_actions, t.products, cancelled=cancelled),
        "hourly_cancel_rate": dl.hourly_cancel_rate(t.orders, t.user_actions, t.courier_actions, cancelled=cancelled),
    }


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["daily_core_metrics", "gross_profit", "daily_revenue", "hourly_cancel_rate"])
def test_order_joins_need_no_exchange(spark, both, name):
    plain, bucketed = (reports(spark, t)[name] for t in both)
    assert "hashpartitioning(order_id" in plan(plain)
    assert "hashpartitioning(order_id" not in plan(bucketed)
    assert sorted(map(str, plain.collect())) == sorted(map(str, bucketed.collect()))


def test_a_file_a_bucket_and_open_again(spark, both):
    plain, bucketed = both
    assert len(bucketed.user_actions.inputFiles()) <= 4
    again = open_bucketed(spark, plain, "layout_test")
    assert again.orders.count() == plain.orders.count()
