"""Delivery service economics: revenue, ARPU, product share, P&L.

Money is carried in bigint cents and printed as doubles; ratios are rounded
exactly (see ``mercata.functions.rounding``). The products dimension is
joined without a hint: the planner's broadcast threshold (a size check on
the scan) decides between broadcast and shuffle join, and AQE re-plans
from real sizes. Nothing is broadcast by a hint; cost model periods and
one-row totals travel as scalar subqueries.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercata.functions.joins import attach, not_in, with_flag
from mercata.functions.lineage import materialize
from mercata.functions.rounding import (
    cents_to_money,
    round_ratio,
    round_ratio_units,
    to_cents,
    units_to_double,
)
from mercata.operators.delivery import CANCEL, DELIVER, given_or_cancelled

# Fixed values of the reference report.
# Product names taxed at the reduced VAT rate (10 %); all others pay 20 %.
REFERENCE_REDUCED_VAT_NAMES = (
    "сахар", "сухарики", "сушки", "семечки",
    "масло льняное", "виноград", "масло оливковое",
    "арбуз", "батон", "йогурт", "сливки", "гречка",
    "овсянка", "макароны", "баранина", "апельсины",
    "бублики", "хлеб", "горох", "сметана", "рыба копченая",
    "мука", "шпроты", "сосиски", "свинина", "рис",
    "масло кунжутное", "сгущенка", "ананас", "говядина",
    "соль", "рыба вяленая", "масло подсолнечное", "яблоки",
    "груши", "лепешка", "молоко", "курица", "лаваш", "вафли", "мандарины",
)
REDUCED_VAT_PERCENT = 10
STANDARD_VAT_PERCENT = 20
# Label of the folded "other products" row and the share (in %) below which
# a product is folded into it.
OTHER_LABEL = "ДРУГОЕ"
OTHER_SHARE_THRESHOLD = 0.5
# Cost model: per-unit costs in whole currency units, effective from a date.
# Before 2022-09-01: packing 140 per order row, delivery 150 per delivered
# order (rows counted), bonus 400 per courier with >= 5 deliveries a day,
# fixed 120000 a day, missing bonus counts as 0. From 2022-09-01: packing
# 115, delivery 150 per distinct order, bonus 500, fixed 150000, a missing
# bonus leaves the day's costs NULL.
REFERENCE_COST_MODEL = (
    # effective_from, package, delivery, bonus, min_deliveries, fixed,
    # distinct_deliveries, bonus_null_as_zero
    (dt.date(1900, 1, 1), 140, 150, 400, 5, 120000, False, True),
    (dt.date(2022, 9, 1), 115, 150, 500, 5, 150000, True, False),
)
FAR_FUTURE = dt.date(9999, 12, 31)


def cost_model_frame(spark: SparkSession, periods: Sequence[tuple] = REFERENCE_COST_MODEL) -> DataFrame:
    """Cost model periods as a small table with [effective_from, effective_to)."""
    rows = sorted(periods, key=lambda r: r[0])
    data = [
        (*row, rows[i + 1][0] if i + 1 < len(rows) else FAR_FUTURE)
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "effective_from date, package bigint, delivery bigint, bonus bigint, "
        "min_deliveries bigint, fixed bigint, distinct_deliveries boolean, "
        "bonus_null_as_zero boolean, effective_to date",
    )


def _with_period(daily: DataFrame, model: DataFrame, date_col: str = "date") -> DataFrame:
    """Attach the cost period in force on each date.

    The model is a parameter table of a few rows: it travels as one array
    (a scalar subquery, evaluated once) and each row picks its period with
    an array filter, so no join is needed. It is applied to aggregated rows
    (per day, or per day and courier); a date outside every period gets NULL
    terms.
    """
    periods = model.agg(F.collect_list(F.struct(*model.columns))).scalar()
    d = F.col(date_col)
    period = F.element_at(
        F.filter("_periods", lambda p: (p["effective_from"] <= d) & (d < p["effective_to"])), 1
    )
    return (
        daily.withColumn("_periods", periods)
        .withColumn("_period", period)
        .select("*", "_period.*")
        .drop("_period", "_periods")
    )


def order_items(orders: DataFrame) -> DataFrame:
    """order_id, creation_time, product_id: one row per basket entry (repeats kept)."""
    return orders.select("order_id", "creation_time", F.explode("product_ids").alias("product_id"))


def priced_items(orders: DataFrame, products: DataFrame, cancelled: DataFrame | None) -> DataFrame:
    """Basket entries of surviving orders joined (inner) to their price."""
    if cancelled is not None:
        orders = not_in(orders, "order_id", cancelled)
    items = order_items(orders)
    return items.join(products.select("product_id", "name", "price"), "product_id").withColumn(
        "cents", to_cents(F.col("price"))
    )


def sold_units(orders: DataFrame, cancelled: DataFrame | None) -> DataFrame:
    """(date, product_id, units) of surviving orders by creation date.

    Basket entries are counted before they meet their price, so the join
    sees days x products rows and a hot product is one row a day."""
    if cancelled is not None:
        orders = not_in(orders, "order_id", cancelled)
    items = orders.select(F.to_date("creation_time").alias("date"), F.explode("product_ids").alias("product_id"))
    return items.groupBy("date", "product_id").agg(F.count(F.lit(1)).alias("units"))


def sales(orders: DataFrame, products: DataFrame, cancelled: DataFrame | None) -> DataFrame:
    """(date, product_id, name, units, cents): takings per day and priced product."""
    priced = products.select("product_id", "name", to_cents(F.col("price")).alias("_c"))
    return sold_units(orders, cancelled).join(priced, "product_id").select(
        "date", "product_id", "name", "units", (F.col("units") * F.col("_c")).alias("cents")
    )


def daily_revenue(
    orders: DataFrame, user_actions: DataFrame, products: DataFrame, cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None
) -> DataFrame:
    """Revenue by creation date, running total, day-over-day % change."""
    sold = sales(orders, products, given_or_cancelled(cancelled, user_actions, cancel_action))
    daily = sold.groupBy("date").agg(F.sum("cents").alias("rev"))
    w = Window.orderBy("date")
    prev = F.lag("rev").over(w)
    return daily.select(
        "date",
        cents_to_money(F.col("rev")).alias("revenue"),
        cents_to_money(F.sum("rev").over(w)).alias("total_revenue"),
        round_ratio((F.col("rev") - prev) * 100, prev, 2).alias("revenue_change"),
    ).orderBy("date")


def arpu_arppu_aov(
    orders: DataFrame, user_actions: DataFrame, products: DataFrame, cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None
) -> DataFrame:
    """Revenue per user, per paying user and per order, by day (inner join
    of the action-date user counts with the creation-date revenue)."""
    from mercata.operators.delivery import daily_users

    cancelled = given_or_cancelled(cancelled, user_actions, cancel_action)
    items = priced_items(orders, products, cancelled)
    revenue = items.groupBy(F.to_date("creation_time").alias("date")).agg(
        F.sum("cents").alias("rev"), F.count_distinct("order_id").alias("n_orders")
    )
    users = daily_users(user_actions, cancelled)
    joined = users.join(revenue, "date")
    rev = F.col("rev")
    return joined.select(
        "date",
        round_ratio(rev, F.col("uniq_users") * 100, 2).alias("arpu"),
        round_ratio(rev, F.col("uniq_paying_users") * 100, 2).alias("arppu"),
        round_ratio(rev, F.col("n_orders") * 100, 2).alias("aov"),
    ).orderBy("date")


def product_revenue_share(
    orders: DataFrame,
    user_actions: DataFrame,
    products: DataFrame,
    other_threshold: float = OTHER_SHARE_THRESHOLD,
    other_label: str = OTHER_LABEL,
    cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None,
) -> DataFrame:
    """Revenue and % share by product name; names whose rounded share is
    below the threshold fold into one ``other_label`` row. Shares are rounded
    per name before folding, so the column need not total 100."""
    sold = sales(orders, products, given_or_cancelled(cancelled, user_actions, cancel_action))
    by_name = sold.groupBy("name").agg(F.sum("cents").alias("rev"))
    # one column that the rounding reads several times, not a subquery each time
    shares = attach(by_name, by_name.agg(F.sum("rev").alias("_total")), []).withColumn(
        "share_units", round_ratio_units(F.col("rev") * 100, F.col("_total"), 2)
    )
    threshold_units = int(round(other_threshold * 100))
    folded = shares.select(
        F.when(F.col("share_units") < threshold_units, F.lit(other_label))
        .otherwise(F.col("name"))
        .alias("product_name"),
        "rev",
        "share_units",
    )
    return (
        folded.groupBy("product_name")
        .agg(F.sum("rev").alias("rev"), F.sum("share_units").alias("share_units"))
        .select(
            "product_name",
            cents_to_money(F.col("rev")).alias("revenue"),
            units_to_double(F.col("share_units"), 2).alias("share_in_revenue"),
        )
        .orderBy(F.desc("revenue"), "product_name")
    )


def order_costs(orders: DataFrame, products: DataFrame) -> DataFrame:
    """order_id, order_cost_cents over every order (cancelled included)."""
    return (
        priced_items(orders, products, None)
        .groupBy("order_id")
        .agg(F.sum("cents").alias("order_cost"))
    )


def new_vs_old_revenue(
    user_actions: DataFrame, orders: DataFrame, products: DataFrame, cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None
) -> DataFrame:
    """Revenue per action date and the part from users whose first-ever
    action date is that date. A day without newcomers has NULL new revenue
    and NULL shares; orders without a priced product add NULL cost."""
    from mercata.operators.delivery import first_seen

    cancelled = given_or_cancelled(cancelled, user_actions, cancel_action)
    first = first_seen(user_actions, "user_id").withColumnRenamed("date", "min_date")
    # Order costs join on order_id; rows are then summed per (date, user)
    # with map-side combine before the join on user_id, so a heavy user
    # reaches that join as at most one row per day.
    per_user_day = (
        not_in(user_actions, "order_id", cancelled)
        .select(F.to_date("time").alias("date"), "user_id", "order_id")
        .join(order_costs(orders, products), "order_id", "left")
        .groupBy("date", "user_id")
        .agg(F.sum("order_cost").alias("cost"))
    )
    daily = (
        per_user_day.join(first, "user_id", "left")
        .groupBy("date")
        .agg(
            F.sum("cost").alias("rev"),
            F.sum(F.when(F.col("date") == F.col("min_date"), F.col("cost"))).alias("new_rev"),
        )
    )
    share = round_ratio_units(F.col("new_rev") * 100, F.col("rev"), 2)
    return daily.select(
        "date",
        cents_to_money(F.col("rev")).alias("revenue"),
        cents_to_money(F.col("new_rev")).alias("new_users_revenue"),
        units_to_double(share, 2).alias("new_users_revenue_share"),
        units_to_double(F.lit(10000) - share, 2).alias("old_users_revenue_share"),
    ).orderBy("date")


# ---------------------------------------------------------------- P&L


def vat_extract(
    products: DataFrame,
    reduced_names: DataFrame,
    reduced_percent: int = REDUCED_VAT_PERCENT,
    standard_percent: int = STANDARD_VAT_PERCENT,
) -> DataFrame:
    """VAT contained in each unit price, rounded to cents per unit.

    tax = round(price * r / (1 + r), 2), computed in integer cents:
    ``(2*p*r + (100+r)) div (2*(100+r))`` for a rate of r percent.
    ``reduced_names`` has one column ``name``; its size decides the join.
    """
    names = reduced_names.select("name").distinct()
    flagged = with_flag(products.select("product_id", "name", "price"), "name", names, "_reduced")
    cents = to_cents(F.col("price"))
    rate = F.when(F.col("_reduced"), F.lit(reduced_percent)).otherwise(F.lit(standard_percent))
    num = cents * 2 * rate + (rate + 100)
    den = (rate + 100) * 2
    tax_cents = ((num - F.pmod(num, den)) / den).cast("bigint")
    return flagged.select("product_id", "name", "price", tax_cents.alias("tax_cents"))


def reduced_vat_names_frame(spark: SparkSession, names: Sequence[str] = REFERENCE_REDUCED_VAT_NAMES) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def revenue_and_tax(
    orders: DataFrame, cancelled: DataFrame, taxed_products: DataFrame
) -> DataFrame:
    """date, rev_cents, tax_cents of surviving orders by creation date."""
    items = sold_units(orders, cancelled).join(
        taxed_products.select("product_id", to_cents(F.col("price")).alias("_c"), "tax_cents"), "product_id"
    )
    return items.groupBy("date").agg(
        F.sum(F.col("units") * F.col("_c")).alias("rev_cents"),
        F.sum(F.col("units") * F.col("tax_cents")).alias("tax_cents"),
    )


def delivery_cost(
    courier_actions: DataFrame, cancelled: DataFrame, model: DataFrame, deliver_action: str = DELIVER
) -> DataFrame:
    """Date, delivery_cost. Rows counted before the model switches to
    distinct orders (reference: before / after 2022-09-01)."""
    delivered = not_in(
        courier_actions.where(F.col("action") == deliver_action), "order_id", cancelled
    )
    daily = delivered.groupBy(F.to_date("time").alias("date")).agg(
        F.count("order_id").alias("n_rows"), F.count_distinct("order_id").alias("n_distinct")
    )
    n = F.when(F.col("distinct_deliveries"), F.col("n_distinct")).otherwise(F.col("n_rows"))
    return _with_period(daily, model).select("date", (n * F.col("delivery")).alias("delivery_cost"))


def packing_cost(user_actions: DataFrame, cancelled: DataFrame, model: DataFrame) -> DataFrame:
    """Date, package_cost = surviving user-action rows x packing rate."""
    daily = (
        not_in(user_actions, "order_id", cancelled)
        .groupBy(F.to_date("time").alias("date"))
        .agg(F.count("order_id").alias("n"))
    )
    return _with_period(daily, model).select("date", (F.col("n") * F.col("package")).alias("package_cost"))


def courier_bonus(courier_actions: DataFrame, model: DataFrame, deliver_action: str = DELIVER) -> DataFrame:
    """B11d: date, bonus_cost = bonus x couriers with >= min_deliveries distinct
    delivered orders that day (cancellations are not excluded here)."""
    per_courier = (
        courier_actions.where(F.col("action") == deliver_action)
        .groupBy(F.to_date("time").alias("date"), "courier_id")
        .agg(F.count_distinct("order_id").alias("n"))
    )
    earned = _with_period(per_courier, model).where(F.col("n") >= F.col("min_deliveries"))
    return earned.groupBy("date").agg(F.sum("bonus").alias("bonus_cost"))


def daily_costs(
    user_actions: DataFrame,
    courier_actions: DataFrame,
    model: DataFrame,
    cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None,
    deliver_action: str = DELIVER,
) -> DataFrame:
    """B11e: date, costs = packing + delivery + bonus + fixed, from the packing
    side (LEFT joins). A missing bonus is 0 only where the period says so;
    a missing delivery term always leaves the day NULL."""
    cancelled = given_or_cancelled(cancelled, user_actions, cancel_action)
    packing = packing_cost(user_actions, cancelled, model)
    bonus = courier_bonus(courier_actions, model, deliver_action)
    delivery = delivery_cost(courier_actions, cancelled, model, deliver_action)
    joined = _with_period(
        packing.join(bonus, "date", "left").join(delivery, "date", "left"), model
    )
    bonus_term = F.when(
        F.col("bonus_null_as_zero"), F.coalesce(F.col("bonus_cost"), F.lit(0))
    ).otherwise(F.col("bonus_cost"))
    costs = F.col("package_cost") + F.col("delivery_cost") + bonus_term + F.col("fixed")
    return joined.select("date", costs.alias("costs"))


def gross_profit(
    user_actions: DataFrame,
    courier_actions: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    reduced_names: DataFrame,
    model: DataFrame,
    cancel_action: str = CANCEL,
    cancelled: DataFrame | None = None,
    deliver_action: str = DELIVER,
) -> DataFrame:
    """Daily P&L with running totals and margins (2 dp)."""
    # One set of cancelled orders serves revenue, packing and delivery.
    if cancelled is None:
        cancelled = materialize(given_or_cancelled(None, user_actions, cancel_action))
    taxed = vat_extract(products, reduced_names)
    rev_tax = revenue_and_tax(orders, cancelled, taxed)
    costs = daily_costs(user_actions, courier_actions, model, cancel_action, cancelled, deliver_action)
    base = costs.join(rev_tax, "date").select(
        "date",
        "rev_cents",
        (F.col("costs") * 100).alias("cost_cents"),
        "tax_cents",
        (F.col("rev_cents") - F.col("costs") * 100 - F.col("tax_cents")).alias("gp_cents"),
    )
    w = Window.orderBy("date")
    total_rev = F.sum("rev_cents").over(w)
    total_gp = F.sum("gp_cents").over(w)
    return base.select(
        "date",
        cents_to_money(F.col("rev_cents")).alias("revenue"),
        cents_to_money(F.col("cost_cents")).alias("costs"),
        cents_to_money(F.col("tax_cents")).alias("tax"),
        cents_to_money(F.col("gp_cents")).alias("gross_profit"),
        cents_to_money(total_rev).alias("total_revenue"),
        cents_to_money(F.sum("cost_cents").over(w)).alias("total_costs"),
        cents_to_money(F.sum("tax_cents").over(w)).alias("total_tax"),
        cents_to_money(total_gp).alias("total_gross_profit"),
        round_ratio(F.col("gp_cents") * 100, F.col("rev_cents"), 2).alias("gross_profit_ratio"),
        round_ratio(total_gp * 100, total_rev, 2).alias("total_gross_profit_ratio"),
    ).orderBy("date")
