"""Day-level retention of users.

Core structure: distinct (user, day) pairs with the previous and next
active day of the same user (``lag``/``lead`` over a user window). The
window runs after de-duplication, so a user's partition holds at most one
row per calendar day however many actions that user has: a heavy user is
bounded by the length of the period, not by its action count.

Quirk Q1: the reference excludes orders cancelled with action
``'cancell_order'`` (misspelt) which matches nothing, so cancelled orders
do count as activity. ``exclude_action`` defaults to that literal value;
pass ``'cancel_order'`` for the evident intent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.joins import action_orders, not_in
from mercata.functions.rounding import round_ratio

# Fixed value of the reference: the action its retention queries exclude.
REFERENCE_EXCLUDED_ACTION = "cancell_order"
RESURRECT_AFTER_DAYS = 14


def activity_date_range(user_actions: DataFrame) -> DataFrame:
    """First and last activity date."""
    return user_actions.agg(
        F.to_date(F.min("time")).alias("min_date"), F.to_date(F.max("time")).alias("max_date")
    )


def active_days(user_actions: DataFrame, exclude_action: str | None = REFERENCE_EXCLUDED_ACTION) -> DataFrame:
    """Distinct (user_id, day) of activity, minus orders with ``exclude_action``."""
    ua = user_actions
    if exclude_action:
        ua = not_in(ua, "order_id", action_orders(ua, exclude_action))
    return ua.select("user_id", F.to_date("time").alias("day")).distinct()


def active_day_neighbours(
    user_actions: DataFrame, exclude_action: str | None = REFERENCE_EXCLUDED_ACTION
) -> DataFrame:
    """user_id, day, previous_active_day, next_active_day."""
    w = Window.partitionBy("user_id").orderBy("day")
    return active_days(user_actions, exclude_action).select(
        "user_id",
        "day",
        F.lag("day").over(w).alias("previous_active_day"),
        F.lead("day").over(w).alias("next_active_day"),
    )


def retained_vs_churned(
    user_actions: DataFrame,
    churn_rule: str = "reference",
    exclude_action: str | None = REFERENCE_EXCLUDED_ACTION,
) -> DataFrame:
    """Per day, users retained from the day before and users churning.

    churn on a user's active day = no next active day, or a gap, and the day
    is not the last day of the data. ``churn_rule='reference'`` measures the
    gap as next - previous > 1 (as written; true for every user active both
    before and after); ``'gap'`` uses next - day > 1.
    """
    if churn_rule not in ("reference", "gap"):
        raise ValueError("churn_rule must be 'reference' or 'gap'")
    nb = active_day_neighbours(user_actions, exclude_action)
    last_day = nb.agg(F.max("day")).scalar()
    base = F.col("previous_active_day") if churn_rule == "reference" else F.col("day")
    churn = (
        F.col("next_active_day").isNull() | (F.datediff("next_active_day", base) > 1)
    ) & (F.col("day") != last_day)
    return (
        nb.groupBy("day")
        .agg(
            F.count_if(F.datediff("day", "previous_active_day") == 1).alias("retained_users"),
            F.count_if(churn).alias("churned_users"),
        )
        .orderBy("day")
    )


def user_lifecycle(
    user_actions: DataFrame,
    resurrect_after: int = RESURRECT_AFTER_DAYS,
    exclude_action: str | None = REFERENCE_EXCLUDED_ACTION,
) -> DataFrame:
    """Per day, active users split into new / retained (gap 1) /
    returned (gap 2 .. resurrect_after-1) / resurrected (gap >= resurrect_after)."""
    nb = active_day_neighbours(user_actions, exclude_action)
    gap = F.datediff("day", "previous_active_day")
    return (
        nb.groupBy("day")
        .agg(
            F.count("user_id").alias("total"),
            F.count_if(F.col("previous_active_day").isNull()).alias("new_users"),
            F.count_if(gap == 1).alias("retained_users"),
            F.count_if((gap > 1) & (gap < resurrect_after)).alias("returned_users"),
            F.count_if(gap >= resurrect_after).alias("resurrected_users"),
        )
        .orderBy("day")
    )


def lag_sanity(
    user_actions: DataFrame,
    limit: int | None = None,
    exclude_action: str | None = REFERENCE_EXCLUDED_ACTION,
) -> DataFrame:
    """Data check, rows whose previous active day is not before the day.

    Must be empty. ``limit`` reproduces the reference's ``LIMIT 20`` view.
    """
    nb = active_day_neighbours(user_actions, exclude_action)
    bad = nb.where(
        F.col("previous_active_day").isNotNull()
        & (F.col("previous_active_day") > F.date_sub("day", 1))
    ).select("user_id", "day", "previous_active_day", F.date_sub("day", 1).alias("day_minus_1"))
    bad = bad.orderBy("user_id", "day")
    return bad.limit(limit) if limit else bad


def daily_cohort_retention(
    user_actions: DataFrame, exclude_action: str | None = REFERENCE_EXCLUDED_ACTION
) -> DataFrame:
    """cohort = first active day; per (cohort, day) active users as an
    integer % of the cohort's day-0 size (the max over the cohort)."""
    days = active_days(user_actions, exclude_action)
    with_start = days.withColumn("cohort", F.min("day").over(Window.partitionBy("user_id")))
    counts = with_start.groupBy("cohort", "day").agg(F.count("user_id").alias("abs_value"))
    start = F.max("abs_value").over(Window.partitionBy("cohort"))
    return counts.select(
        F.month("cohort").alias("start_month"),
        "cohort",
        F.month("day").alias("month"),
        "day",
        round_ratio(F.col("abs_value") * 100, start, 0).cast("int").alias("retention"),
    ).orderBy("start_month", "cohort", "month", "day")
