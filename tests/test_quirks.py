"""Hand-written micro fixtures, one per semantic quirk, with literal expectations."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mercata.functions.joins import mark_not_in, not_in
from mercata.operators import cohort as ch
from mercata.operators import delivery as dl
from mercata.operators import economics as ec
from mercata.operators import experiment as ab
from mercata.operators import retention as rt
from mercata.operators import rfm as rf
from mercata.sources.tables import COURIER_ACTIONS, ORDERS, PRODUCTS, RETAIL, USER_ACTIONS

D0 = dt.datetime(2022, 8, 24, 12, 0)


def ts(day: int, hour: int = 12, minute: int = 0) -> dt.datetime:
    return dt.datetime(2022, 8, 24) + dt.timedelta(days=day, hours=hour, minutes=minute)


def ua(spark, rows):
    return spark.createDataFrame(rows, USER_ACTIONS)


def ca(spark, rows):
    return spark.createDataFrame(rows, COURIER_ACTIONS)


def test_not_in_null_key(spark):
    df = spark.createDataFrame([(None,), (10,), (11,)], "order_id bigint")
    some = spark.createDataFrame([(11,)], "order_id bigint")
    none = spark.createDataFrame([], "order_id bigint")
    assert sorted(r[0] for r in not_in(df, "order_id", some).collect()) == [10]
    assert sorted(not_in(df, "order_id", none).collect(), key=str) == sorted(
        df.collect(), key=str
    )
    flags = {r.order_id: r.ok for r in mark_not_in(df, "order_id", some, "ok").collect()}
    assert flags == {None: False, 10: True, 11: False}
    flags = {r.order_id: r.ok for r in mark_not_in(df, "order_id", none, "ok").collect()}
    assert flags == {None: True, 10: True, 11: True}


def test_cancel_after_midnight_counts_activity_not_payment(spark):
    actions = ua(
        spark,
        [(1, 100, "create_order", ts(0, 23, 55)), (1, 100, "cancel_order", ts(1, 0, 5))],
    )
    couriers = ca(spark, [(7, 100, "accept_order", ts(0, 23, 58))])
    orders = spark.createDataFrame([(100, ts(0, 23, 55), [1])], ORDERS)
    rows = {r.date: r for r in dl.daily_core_metrics(actions, couriers, orders).collect()}
    day1 = rows[dt.date(2022, 8, 25)]
    assert (day1.uniq_users, day1.uniq_paying_users) == (1, 0)
    assert day1.uniq_couriers is None  # no courier action that day: NULL, not 0


def test_delivery_day_without_user_action_is_absent(spark):
    actions = ua(spark, [(1, 100, "create_order", ts(0))])
    couriers = ca(spark, [(7, 100, "deliver_order", ts(2))])
    orders = spark.createDataFrame([(100, ts(0), [1])], ORDERS)
    days = [r.date for r in dl.daily_core_metrics(actions, couriers, orders).collect()]
    assert days == [dt.date(2022, 8, 24)]


def test_growth_inner_join_drops_newcomers(spark):
    actions = ua(spark, [(1, 1, "create_order", ts(0)), (2, 2, "create_order", ts(1))])
    couriers = ca(spark, [(7, 1, "accept_order", ts(0))])
    inner = dl.audience_growth(actions, couriers).collect()
    assert [(r.date, r.total_users) for r in inner] == [(dt.date(2022, 8, 24), 1)]
    full = dl.audience_growth(actions, couriers, join_how="full").collect()
    assert [(r.new_users, r.total_users, r.total_couriers) for r in full] == [(1, 1, 1), (1, 2, 1)]


def test_empty_basket_is_null_bucket_and_no_revenue(spark):
    orders = spark.createDataFrame([(1, ts(0), []), (2, ts(1), [5, 5])], ORDERS)
    products = spark.createDataFrame([(5, "milk", 10)], "product_id bigint, name string, price int")
    products = products.withColumn("price", F.col("price").cast("decimal(12,2)"))
    sizes = {r.number_of_products: r.frequency for r in dl.basket_size_distribution(orders).collect()}
    assert sizes == {None: 1, 2: 1}
    actions = ua(spark, [(1, 1, "create_order", ts(0)), (1, 2, "create_order", ts(1))])
    rev = ec.daily_revenue(orders, actions, products).collect()
    assert [(r.date, r.revenue) for r in rev] == [(dt.date(2022, 8, 25), 20.0)]  # repeats count


def test_unpriced_product_gives_null_order_cost(spark):
    orders = spark.createDataFrame([(1, ts(0), [99])], ORDERS)
    products = spark.createDataFrame([], PRODUCTS)
    actions = ua(spark, [(1, 1, "create_order", ts(0))])
    row = ec.new_vs_old_revenue(actions, orders, products).collect()[0]
    assert row.revenue is None and row.new_users_revenue_share is None


def _pnl_inputs(spark, deliveries_per_courier: int, day: int):
    actions, couriers = [], []
    for i in range(deliveries_per_courier):
        actions.append((1, 1000 + i, "create_order", ts(day)))
        couriers.append((7, 1000 + i, "deliver_order", ts(day, 13)))
    return ua(spark, actions), ca(spark, couriers)


@pytest.mark.parametrize(
    "day, deliveries, bonus, costs",
    [
        (0, 4, None, 4 * 140 + 4 * 150 + 0 + 120000),  # before cutover: no bonus -> 0
        (0, 5, 400, 5 * 140 + 5 * 150 + 400 + 120000),
        (10, 4, None, None),  # after cutover: a missing bonus leaves the day NULL
        (10, 5, 500, 5 * 115 + 5 * 150 + 500 + 150000),
    ],
)
def test_costs_bonus_and_cutover(spark, day, deliveries, bonus, costs):
    actions, couriers = _pnl_inputs(spark, deliveries, day)
    model = ec.cost_model_frame(spark)
    b = ec.courier_bonus(couriers, model).collect()
    assert (b[0].bonus_cost if b else None) == bonus
    c = ec.daily_costs(actions, couriers, model).collect()
    assert c[0].costs == costs


def test_share_of_0495_rounds_up_and_is_kept(spark):
    orders = spark.createDataFrame([(1, ts(0), [1, 2])], ORDERS)
    products = spark.createDataFrame(
        [(1, "salt", "4.95"), (2, "bread", "995.05")], "product_id bigint, name string, price string"
    ).withColumn("price", F.col("price").cast("decimal(12,2)"))
    actions = ua(spark, [(1, 1, "create_order", ts(0))])
    rows = {r.product_name: r.share_in_revenue for r in ec.product_revenue_share(orders, actions, products).collect()}
    assert rows == {"salt": 0.5, "bread": 99.51}  # 0.495 and 99.505 round up; total 100.01


def test_lifecycle_gaps(spark):
    days = [0, 1, 3, 16, 30]
    actions = ua(spark, [(1, 100 + d, "create_order", ts(d)) for d in days])
    got = {
        (r.day - dt.date(2022, 8, 24)).days: (r.new_users, r.retained_users, r.returned_users, r.resurrected_users)
        for r in rt.user_lifecycle(actions).collect()
    }
    assert got == {0: (1, 0, 0, 0), 1: (0, 1, 0, 0), 3: (0, 0, 1, 0), 16: (0, 0, 1, 0), 30: (0, 0, 0, 1)}


@pytest.mark.parametrize("rule", ["reference", "gap"])
def test_churn_single_day_and_last_day(spark, rule):
    actions = ua(spark, [(1, 1, "create_order", ts(0)), (2, 2, "create_order", ts(5))])
    got = {(r.day - dt.date(2022, 8, 24)).days: r.churned_users for r in rt.retained_vs_churned(actions, rule).collect()}
    assert got == {0: 1, 5: 0}


def test_churn_rules_differ_for_users_active_before_and_after(spark):
    actions = ua(spark, [(1, d, "create_order", ts(d)) for d in (0, 1, 2)] + [(2, 9, "create_order", ts(9))])
    ref = {(r.day - dt.date(2022, 8, 24)).days: r.churned_users for r in rt.retained_vs_churned(actions, "reference").collect()}
    gap = {(r.day - dt.date(2022, 8, 24)).days: r.churned_users for r in rt.retained_vs_churned(actions, "gap").collect()}
    assert ref[1] == 1 and gap[1] == 0  # next - previous = 2 > 1 although next - day = 1


def test_misspelt_exclusion_keeps_cancelled_activity(spark):
    actions = ua(spark, [(1, 1, "create_order", ts(0)), (1, 1, "cancel_order", ts(0, 13))])
    assert rt.active_days(actions).count() == 1
    assert rt.active_days(actions, exclude_action="cancel_order").count() == 0


def test_p99_ties_are_in_neither_frame(spark):
    rows = [(i, "ad" if i % 2 else "psa", False, i, "Monday", 1) for i in range(1, 98)]
    rows += [(1000 + i, "ad", False, 500, "Monday", 1) for i in range(3)]
    df = spark.createDataFrame(
        rows, "user_id bigint, test_group string, converted boolean, total_ads int, most_ads_day string, most_ads_hour int"
    )
    assert ab.exposure_threshold(df).collect()[0].threshold == 500.0
    assert ab.ab_trim(df).count() == 97
    assert ab.ab_outlier_profile(df).count() == 0


def _rfm(spark, values):
    return spark.createDataFrame(
        [(i, v, v, float(v)) for i, v in enumerate(values)],
        "CustomerID bigint, Recency bigint, Frequency bigint, MonetaryValue double",
    )


def test_tercile_edge_goes_to_lower_bin(spark):
    scored = {r.Recency: (r.R, r.F, r.M) for r in rf.rfm_scores(_rfm(spark, [1, 2, 3, 4, 5, 6, 7])).collect()}
    # edges 1, 3, 5, 7: value 3 is in the first bin, 5 in the second
    assert scored[3] == (3, 1, 1)
    assert scored[4] == (2, 2, 2)
    assert scored[5] == (2, 2, 2)
    assert scored[6] == (1, 3, 3)


def test_duplicate_tercile_edges_raise(spark):
    with pytest.raises(PySparkException, match="duplicate bin edges"):
        rf.rfm_scores(_rfm(spark, [1, 1, 1, 1, 2])).collect()


def test_recency_counts_whole_days(spark):
    tx = spark.createDataFrame(
        [
            (1, 1, "a", 1, dt.datetime(2011, 1, 1, 0, 0), "1.00", 10, "UK"),
            (2, 1, "a", 1, dt.datetime(2011, 1, 1, 23, 0), "1.00", 20, "UK"),
        ],
        "InvoiceNo bigint, StockCode bigint, Description string, Quantity int, InvoiceDate timestamp_ntz, "
        "UnitPrice string, CustomerID bigint, Country string",
    ).withColumn("UnitPrice", F.col("UnitPrice").cast("decimal(12,2)"))
    assert tx.schema == RETAIL
    got = {r.CustomerID: r.Recency for r in rf.rfm_matrix(rf.with_line_total(tx)).collect()}
    assert got == {10: 1, 20: 1}  # 47 h and 24 h before the snapshot


def test_log_of_non_positive_is_null(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.0), (2, 1, 1, -5.0)], "CustomerID bigint, Recency bigint, Frequency bigint, MonetaryValue double")
    assert [r.MonetaryValue for r in rf.rfm_log(df).orderBy("CustomerID").collect()] == [None, None]


def test_skipped_cohort_month_is_null(spark):
    tx = spark.createDataFrame(
        [(1, dt.datetime(2011, 1, 5)), (1, dt.datetime(2011, 3, 5))], "CustomerID bigint, InvoiceDate timestamp_ntz"
    )
    row = ch.cohort_matrix_wide(tx, indices=(1, 2, 3)).collect()[0]
    assert (row.m1, row.m2, row.m3) == (1, None, 1)


def test_wide_cohort_rejects_unlisted_index(spark):
    tx = spark.createDataFrame(
        [(1, dt.datetime(2011, 1, 5)), (1, dt.datetime(2011, 4, 5))], "CustomerID bigint, InvoiceDate timestamp_ntz"
    )
    with pytest.raises(PySparkException, match="outside"):
        ch.cohort_matrix_wide(tx, indices=(1, 2, 3)).collect()


def test_frequency_lines_vs_distinct_invoices(spark):
    tx = spark.createDataFrame(
        [(1, 1, "a", 1, dt.datetime(2011, 1, 1), "1.00", 10, "UK"),
         (1, 2, "b", 1, dt.datetime(2011, 1, 1), "2.00", 10, "UK"),
         (2, 1, "a", 1, dt.datetime(2011, 1, 2), "1.00", 10, "UK")],
        "InvoiceNo bigint, StockCode bigint, Description string, Quantity int, InvoiceDate timestamp_ntz, "
        "UnitPrice string, CustomerID bigint, Country string",
    ).withColumn("UnitPrice", F.col("UnitPrice").cast("decimal(12,2)"))
    lt = rf.with_line_total(tx)
    assert rf.rfm_matrix(lt).first().Frequency == 3  # invoice lines (reference)
    assert rf.rfm_matrix(lt, distinct_invoices=True).first().Frequency == 2
    assert rf.rfm_matrix(lt).first().MonetaryValue == 4.0


def test_lag_sanity_top_k(spark):
    # previous-day anomalies cannot occur in well-formed data: empty either way
    actions = ua(spark, [(u, u, "create_order", ts(u % 5)) for u in range(30)])
    assert rt.lag_sanity(actions).count() == 0
    assert rt.lag_sanity(actions, limit=20).count() == 0


def test_other_threshold_and_label(spark):
    orders = spark.createDataFrame([(1, ts(0), [1, 2, 3])], ORDERS)
    products = spark.createDataFrame(
        [(1, "a", "1.00"), (2, "b", "2.00"), (3, "c", "97.00")], "product_id bigint, name string, price string"
    ).withColumn("price", F.col("price").cast("decimal(12,2)"))
    actions = ua(spark, [(1, 1, "create_order", ts(0))])
    rows = {
        r.product_name: (r.revenue, r.share_in_revenue)
        for r in ec.product_revenue_share(orders, actions, products, other_threshold=5, other_label="OTHER").collect()
    }
    assert rows == {"OTHER": (3.0, 3.0), "c": (97.0, 97.0)}


def test_heatmap_clipping_and_labels(spark):
    tx = spark.createDataFrame(
        [(c, dt.datetime(2011, 1, 5)) for c in range(8)] + [(c, dt.datetime(2011, 2, 5)) for c in range(5)],
        "CustomerID bigint, InvoiceDate timestamp_ntz",
    )
    rows = {r.CohortIndex: r for r in ch.cohort_heatmap_frame(tx).collect()}
    assert rows[1].rate == 1.0 and rows[1].rate_clipped == 0.5 and rows[1].label == "100.0%"
    assert rows[2].rate == 0.625 and rows[2].rate_clipped == 0.5 and rows[2].label == "62.5%"
    assert rows[1].cohort_label == "2011-01"
