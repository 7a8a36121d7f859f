"""Marketing campaign comparison.

The reference lists the metrics (CAC, ROI, AOV, retention, ARPPU) of a
campaign report whose code it does not include; the definitions here are
the standard ones. Inputs: ``campaign_users(campaign, user_id)``, one row a
user, ``spend(campaign, amount)`` and the delivery service tables. A campaign
without a spend row (organic users) stays, with NULL spend and NULL ratios.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.joins import not_in
from mercata.functions.rounding import cents_to_money, round_ratio, to_cents
from mercata.operators.delivery import cancelled_orders

RETENTION_DAYS = (0, 1, 3, 7)


def paid_orders(
    campaign_users: DataFrame, user_actions: DataFrame, orders: DataFrame, products: DataFrame
) -> DataFrame:
    """campaign, user_id, order_id, date, rev_cents for surviving orders of
    campaign users (orders without a priced product have NULL revenue)."""
    cancelled = cancelled_orders(user_actions)
    # Campaign users come first: only their orders are unpacked and priced.
    owners = (
        not_in(user_actions, "order_id", cancelled)
        .select("user_id", "order_id")
        .distinct()
        .join(campaign_users, "user_id")
    )
    bought = owners.join(orders, "order_id").select(
        "campaign", "user_id", "order_id", F.to_date("creation_time").alias("date"), "product_ids"
    )
    items = bought.select("user_id", "order_id", F.explode("product_ids").alias("product_id"))
    revenue = (
        items.join(products.select("product_id", to_cents(F.col("price")).alias("cents")), "product_id")
        .groupBy("user_id", "order_id")
        .agg(F.sum("cents").alias("rev_cents"))
    )
    return bought.drop("product_ids").join(revenue, ["user_id", "order_id"], "left")


def _totals(campaign_users: DataFrame, paid: DataFrame, spend: DataFrame) -> DataFrame:
    users = campaign_users.groupBy("campaign").agg(F.count_distinct("user_id").alias("users"))
    agg = paid.groupBy("campaign").agg(
        F.count_distinct("user_id").alias("paying_users"),
        F.count_distinct("order_id").alias("n_orders"),
        F.sum("rev_cents").alias("rev_cents"),
    )
    return (
        users.join(spend, "campaign", "left")
        .join(agg, "campaign", "left")
        .fillna(0, ["paying_users", "n_orders", "rev_cents"])
    )


def campaign_cac(campaign_users, user_actions, orders, products, spend) -> DataFrame:
    """Acquisition cost per paying user = spend / paying users (2 dp)."""
    t = _totals(campaign_users, paid_orders(campaign_users, user_actions, orders, products), spend)
    return t.select(
        "campaign",
        "users",
        "paying_users",
        F.col("amount").alias("spend"),
        round_ratio(F.col("amount"), F.col("paying_users"), 2).alias("cac"),
    ).orderBy("campaign")


def campaign_roi(campaign_users, user_actions, orders, products, spend) -> DataFrame:
    """Revenue and ROI % = (revenue - spend) / spend x 100 (2 dp)."""
    t = _totals(campaign_users, paid_orders(campaign_users, user_actions, orders, products), spend)
    spend_cents = F.col("amount") * 100
    return t.select(
        "campaign",
        cents_to_money(F.col("rev_cents")).alias("revenue"),
        F.col("amount").alias("spend"),
        round_ratio((F.col("rev_cents") - spend_cents) * 100, spend_cents, 2).alias("roi_pct"),
    ).orderBy("campaign")


def campaign_aov(campaign_users, user_actions, orders, products, spend) -> DataFrame:
    """D3: mean over paying users of their own average order value (2 dp),
    with orders, revenue and revenue per order beside it.

    A user's average is a whole number of cents over a whole number of orders;
    the mean of these is taken in doubles and rounded at the end."""
    paid = paid_orders(campaign_users, user_actions, orders, products)
    per_user = paid.groupBy("campaign", "user_id").agg(
        F.coalesce(F.sum("rev_cents"), F.lit(0)).alias("cents"), F.count_distinct("order_id").alias("n")
    )
    totals = per_user.groupBy("campaign").agg(
        F.sum("n").alias("n_orders"),
        F.sum("cents").alias("cents"),
        F.avg(F.col("cents").cast("double") / F.col("n") / F.lit(100.0)).alias("aov"),
    )
    every = campaign_users.select("campaign").distinct()
    return (
        every.join(totals, "campaign", "left")
        .fillna(0, ["n_orders", "cents"])
        .select(
            "campaign",
            "n_orders",
            cents_to_money(F.col("cents")).alias("revenue"),
            F.round("aov", 2).alias("aov"),
            round_ratio(F.col("cents"), F.col("n_orders") * 100, 2).alias("revenue_per_order"),
        )
        .orderBy("campaign")
    )


def campaign_retention(
    campaign_users: DataFrame, user_actions: DataFrame, days: Sequence[int] = RETENTION_DAYS
) -> DataFrame:
    """Share of a campaign's users active N days after their first
    activity, for N in ``days`` (0 % rows included)."""
    active = user_actions.select("user_id", F.to_date("time").alias("day")).distinct()
    first = F.min("day").over(Window.partitionBy("user_id"))
    offsets = active.withColumn("day_offset", F.datediff("day", first)).where(
        F.col("day_offset").isin(*days)
    )
    counts = (
        campaign_users.join(offsets, "user_id")
        .groupBy("campaign", "day_offset")
        .agg(F.count_distinct("user_id").alias("active_users"))
    )
    sizes = campaign_users.groupBy("campaign").agg(F.count_distinct("user_id").alias("_size"))
    grid = sizes.withColumn("day_offset", F.explode(F.array(*[F.lit(int(d)) for d in days])))
    return (
        grid.join(counts, ["campaign", "day_offset"], "left")
        .select(
            "campaign",
            "day_offset",
            F.coalesce(F.col("active_users"), F.lit(0)).alias("active_users"),
            round_ratio(F.coalesce(F.col("active_users"), F.lit(0)) * 100, F.col("_size"), 2).alias(
                "retention_pct"
            ),
        )
        .orderBy("campaign", "day_offset")
    )


def campaign_arppu(campaign_users, user_actions, orders, products, spend) -> DataFrame:
    """By campaign and order date, cumulative revenue, cumulative paying
    users, cumulative ARPPU (2 dp) and whether revenue has paid back spend."""
    paid = paid_orders(campaign_users, user_actions, orders, products)
    daily_rev = paid.groupBy("campaign", "date").agg(F.sum("rev_cents").alias("rev"))
    first_paid = paid.groupBy("campaign", "user_id").agg(F.min("date").alias("date"))
    new_payers = first_paid.groupBy("campaign", "date").agg(F.count("user_id").alias("new_payers"))
    daily = (
        daily_rev.join(new_payers, ["campaign", "date"], "full")
        .fillna(0, ["rev", "new_payers"])
        .join(spend, "campaign", "left")
    )
    w = Window.partitionBy("campaign").orderBy("date")
    cum_rev = F.sum("rev").over(w)
    cum_payers = F.sum("new_payers").over(w)
    return daily.select(
        "campaign",
        "date",
        cents_to_money(cum_rev).alias("cumulative_revenue"),
        cum_payers.alias("cumulative_paying_users"),
        round_ratio(cum_rev, cum_payers * 100, 2).alias("cumulative_arppu"),
        (cum_rev >= F.col("amount") * 100).alias("paid_back"),
    ).orderBy("campaign", "date")


def campaign_payback(campaign_users, user_actions, orders, products, spend) -> DataFrame:
    """D5, the day a campaign pays: per campaign with a spend, the first date on
    which cumulative revenue covers it, its number counted from the first
    order's date (1), and the revenue by then. NULL while it hasn't paid back."""
    daily = campaign_arppu(campaign_users, user_actions, orders, products, spend).where(F.col("paid_back").isNotNull())
    paid = F.when(F.col("paid_back"), F.struct("date", "cumulative_revenue"))
    per = daily.groupBy("campaign").agg(F.min("date").alias("_first"), F.min(paid).alias("_paid"))
    return per.select(
        "campaign",
        F.col("_paid.date").alias("payback_date"),
        (F.datediff("_paid.date", "_first") + 1).alias("payback_day"),
        F.col("_paid.cumulative_revenue").alias("revenue_by_then"),
    ).orderBy("campaign")
