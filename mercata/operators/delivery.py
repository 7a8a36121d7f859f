"""Delivery service: activity, orders and audience growth.

Inputs follow the service schema: ``user_actions(user_id, order_id,
action, time)``, ``courier_actions(courier_id, order_id, action, time)``,
``orders(order_id, creation_time, product_ids)``.

Plan notes. The cancelled-order set is built once per report as a
distinct, null-free key set and used through equi-joins (anti join for
``NOT IN`` in WHERE, left join + flag for ``NOT IN`` inside an aggregate
FILTER). Distinct counts by date are planned by Catalyst with an Expand
whose shuffle keys include the counted id, so a hot date is spread over
many reducers. Running totals and lags run over one row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.joins import action_orders, mark_not_in, not_in, with_flag
from mercata.functions.rounding import round_ratio

CANCEL = "cancel_order"
DELIVER = "deliver_order"


def cancelled_orders(user_actions: DataFrame, action: str = CANCEL) -> DataFrame:
    return action_orders(user_actions, action)


def given_or_cancelled(
    cancelled: DataFrame | None, user_actions: DataFrame, action: str = CANCEL
) -> DataFrame:
    """The caller's (e.g. persisted) cancelled-order set, or a fresh one."""
    return cancelled if cancelled is not None else cancelled_orders(user_actions, action)


def _daily_presence(rows: DataFrame, ts: str, key: str, cancelled: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Per date, distinct keys and distinct keys with a non-cancelled order row.

    Two levels: one row per (date, key) with map-side combine, then plain
    counts; a hot date is spread over its keys, and no row is expanded."""
    dated = rows.select(F.to_date(ts).alias("date"), F.col(key).alias("_k"), "order_id")
    marked = mark_not_in(dated, "order_id", cancelled, "_ok")
    per_key = marked.groupBy("date", "_k").agg(F.max(F.coalesce("_ok", F.lit(False))).alias("_ok"))
    return per_key.groupBy("date").agg(
        F.count("_k").alias(names[0]), F.count_if(F.col("_ok") & F.col("_k").isNotNull()).alias(names[1])
    )


def daily_users(user_actions: DataFrame, cancelled: DataFrame) -> DataFrame:
    """date, uniq_users, uniq_paying_users (users with a non-cancelled order row)."""
    return _daily_presence(user_actions, "time", "user_id", cancelled, ("uniq_users", "uniq_paying_users"))


def daily_core_metrics(
    user_actions: DataFrame, courier_actions: DataFrame, orders: DataFrame, cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None
) -> DataFrame:
    """B1: per action date, distinct users / paying users / couriers / active
    couriers / orders / successful orders. Dates without a user action are
    absent; missing courier or order sides are NULL."""
    cancelled = given_or_cancelled(cancelled, user_actions, cancel_action)
    users = daily_users(user_actions, cancelled)
    couriers = _daily_presence(
        courier_actions, "time", "courier_id", cancelled, ("uniq_couriers", "uniq_active_couriers")
    )
    order_counts = _daily_presence(orders, "creation_time", "order_id", cancelled, ("orders", "successful_orders"))
    return (
        users.join(couriers, "date", "left")
        .join(order_counts, "date", "left")
        .select(
            "date",
            "uniq_users",
            "uniq_paying_users",
            "uniq_couriers",
            "uniq_active_couriers",
            "orders",
            "successful_orders",
        )
        .orderBy("date")
    )


def order_multiplicity_share(user_actions: DataFrame, cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None) -> DataFrame:
    """B2: per date, % of users with exactly one vs several surviving order rows."""
    cancelled = given_or_cancelled(cancelled, user_actions, cancel_action)
    per_user = (
        not_in(user_actions, "order_id", cancelled)
        .groupBy(F.to_date("time").alias("date"), "user_id")
        .agg(F.count("order_id").alias("n"))
    )
    status = per_user.groupBy("date").agg(
        F.count_if(F.col("n") == 1).alias("one_order"),
        F.count_if(F.col("n") > 1).alias("several_orders"),
    )
    total = F.col("one_order") + F.col("several_orders")
    return status.select(
        "date",
        round_ratio(F.col("one_order") * 100, total, 2).alias("single_order_users_share"),
        round_ratio(F.col("several_orders") * 100, total, 2).alias("several_orders_users_share"),
    ).orderBy("date")


def hourly_cancel_rate(
    orders: DataFrame,
    user_actions: DataFrame,
    courier_actions: DataFrame,
    cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None,
    deliver_action: str = DELIVER,
) -> DataFrame:
    """By creation hour, delivered orders, cancelled orders, cancel rate (3 dp)."""
    delivered = action_orders(courier_actions, deliver_action)
    cancelled = given_or_cancelled(cancelled, user_actions, cancel_action)
    flagged = with_flag(
        with_flag(
            orders.select(F.hour("creation_time").alias("hour"), "order_id"),
            "order_id",
            delivered,
            "_delivered",
        ),
        "order_id",
        cancelled,
        "_cancelled",
    )
    counts = flagged.groupBy("hour").agg(
        F.count_if(F.col("_delivered")).alias("successful_orders"),
        F.count_if(F.col("_cancelled")).alias("canceled_orders"),
        F.count("order_id").alias("n_orders"),
    )
    return counts.select(
        F.col("hour").cast("int").alias("hour"),
        "successful_orders",
        "canceled_orders",
        round_ratio(F.col("canceled_orders"), F.col("n_orders"), 3).alias("cancel_rate"),
    ).orderBy("hour")


def basket_size_distribution(orders: DataFrame) -> DataFrame:
    """Number of orders per basket size; an empty basket is the NULL size."""
    size = F.size("product_ids")
    return (
        orders.select(F.when(size > 0, size).alias("number_of_products"))
        .groupBy("number_of_products")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.desc("frequency"), F.asc_nulls_last("number_of_products"))
    )


def first_seen(actions: DataFrame, id_col: str) -> DataFrame:
    """id, date of its first action of any kind."""
    return actions.groupBy(id_col).agg(F.min(F.to_date("time")).alias("date"))


def audience_growth(
    user_actions: DataFrame, courier_actions: DataFrame, join_how: str = "inner"
) -> DataFrame:
    """New users / couriers per date and running totals.

    The reference joins the two sides with an INNER join: a date that has
    new users but no new couriers (or the reverse) is dropped and its
    newcomers never reach the totals. ``join_how='full'`` keeps them.
    """
    new_users = first_seen(user_actions, "user_id").groupBy("date").agg(
        F.count("user_id").alias("new_users")
    )
    new_couriers = first_seen(courier_actions, "courier_id").groupBy("date").agg(
        F.count("courier_id").alias("new_couriers")
    )
    joined = new_users.join(new_couriers, "date", join_how)
    if join_how != "inner":
        joined = joined.fillna(0, ["new_users", "new_couriers"])
    w = Window.orderBy("date")
    return joined.select(
        "date",
        "new_users",
        "new_couriers",
        F.sum("new_users").over(w).cast("int").alias("total_users"),
        F.sum("new_couriers").over(w).cast("int").alias("total_couriers"),
    ).orderBy("date")


def _pct_change(column: str, w: Window) -> F.Column:
    prev = F.lag(column).over(w)
    return round_ratio((F.col(column) - prev) * 100, prev, 2)


def audience_growth_rates(
    user_actions: DataFrame, courier_actions: DataFrame, join_how: str = "inner"
) -> DataFrame:
    """B5 plus day-over-day % change of the four series (first row NULL)."""
    growth = audience_growth(user_actions, courier_actions, join_how)
    w = Window.orderBy("date")
    return growth.select(
        "date",
        "new_users",
        "new_couriers",
        "total_users",
        "total_couriers",
        _pct_change("new_users", w).alias("new_users_change"),
        _pct_change("new_couriers", w).alias("new_couriers_change"),
        _pct_change("total_users", w).alias("total_users_growth"),
        _pct_change("total_couriers", w).alias("total_couriers_growth"),
    ).orderBy("date")
