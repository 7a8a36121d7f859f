"""Whole dashboards: every report of one dashboard, built and written together.

The reports of a dashboard share their inputs. The one intermediate they
all repeat (the distinct cancelled-order set) is computed once and
persisted (memory and disk; recomputed from lineage if an executor is
lost) while the reports are written, then released.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from mercata.operators import delivery as dl
from mercata.operators import economics as ec
from mercata.operators import retention as rt
from mercata.sources.fixtures import DeliveryTables
from mercata.sources.sinks import write_report

Reports = dict[str, DataFrame]


def delivery_overview(t: DeliveryTables, model: DataFrame, cancelled: DataFrame | None = None) -> Reports:
    """Activity, orders, growth and economics reports of the service."""
    c = dl.given_or_cancelled(cancelled, t.user_actions)
    ua, ca, o, p = t.user_actions, t.courier_actions, t.orders, t.products
    return {
        "daily_core_metrics": dl.daily_core_metrics(ua, ca, o, cancelled=c),
        "order_multiplicity_share": dl.order_multiplicity_share(ua, cancelled=c),
        "hourly_cancel_rate": dl.hourly_cancel_rate(o, ua, ca, cancelled=c),
        "basket_size_distribution": dl.basket_size_distribution(o),
        "audience_growth_rates": dl.audience_growth_rates(ua, ca),
        "daily_revenue": ec.daily_revenue(o, ua, p, cancelled=c),
        "arpu_arppu_aov": ec.arpu_arppu_aov(o, ua, p, cancelled=c),
        "product_revenue_share": ec.product_revenue_share(o, ua, p, cancelled=c),
        "new_vs_old_revenue": ec.new_vs_old_revenue(ua, o, p, cancelled=c),
        "gross_profit": ec.gross_profit(ua, ca, o, p, t.reduced_vat_names, model, cancelled=c),
    }


def retention_overview(t: DeliveryTables, cancelled: DataFrame | None = None) -> Reports:
    """Retention dashboard: churn, lifecycle decomposition, daily cohorts."""
    return {
        "activity_date_range": rt.activity_date_range(t.user_actions),
        "retained_vs_churned": rt.retained_vs_churned(t.user_actions),
        "user_lifecycle": rt.user_lifecycle(t.user_actions),
        "lag_sanity": rt.lag_sanity(t.user_actions),
        "daily_cohort_retention": rt.daily_cohort_retention(t.user_actions),
    }


DATE_PARTITIONED = {
    "daily_core_metrics",
    "order_multiplicity_share",
    "audience_growth_rates",
    "daily_revenue",
    "arpu_arppu_aov",
    "new_vs_old_revenue",
    "gross_profit",
}


def write_dashboard(
    tables: DeliveryTables,
    build: Callable[[DeliveryTables, DataFrame], Reports],
    out_dir: str,
) -> list[str]:
    """Build a dashboard over ``tables`` with the cancelled-order set computed
    once and persisted, write every report under ``out_dir``; returns the
    paths written."""
    cancelled = dl.cancelled_orders(tables.user_actions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        paths = []
        for name, df in build(tables, cancelled).items():
            path = os.path.join(out_dir, name)
            write_report(df, path, partition_by="date" if name in DATE_PARTITIONED else None)
            paths.append(path)
        return paths
    finally:
        cancelled.unpersist()
