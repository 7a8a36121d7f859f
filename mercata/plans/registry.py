"""Registered report queries: key -> callable(spark, sf_dir) -> DataFrame.

Each builder maps the driver tables onto the logical inputs
(``mercata.sources.fixtures``) and runs one operator over the whole
tables. Float statistics are rounded at the end (``_r``) so results can be
compared value by value with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.functions.lineage import materialize
from mercata.operators import delivery as dl
from mercata.operators import economics as ec
from mercata.sources import fixtures as fx
from mercata.sources import tables as tb

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}


def register(name: str) -> Callable[[Builder], Builder]:
    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn

    return wrap


def _r(df: DataFrame, digits: int = 6, columns: list[str] | None = None) -> DataFrame:
    """Round the given (default: all double) columns for oracle comparison."""
    targets = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in targets})


# ------------------------------------------------------------------ delivery


def _dash(spark: SparkSession, d: str) -> fx.DeliveryTables:
    return fx.delivery_tables(spark, d, fx.DASHBOARD_PERIOD_DAYS)


@register("daily_core_metrics")
def q_daily_core_metrics(spark, d):
    t = _dash(spark, d)
    return dl.daily_core_metrics(t.user_actions, t.courier_actions, t.orders)


@register("order_multiplicity_share")
def q_order_multiplicity_share(spark, d):
    return dl.order_multiplicity_share(_dash(spark, d).user_actions)


@register("hourly_cancel_rate")
def q_hourly_cancel_rate(spark, d):
    t = _dash(spark, d)
    return dl.hourly_cancel_rate(t.orders, t.user_actions, t.courier_actions)


@register("basket_size_distribution")
def q_basket_size_distribution(spark, d):
    return dl.basket_size_distribution(_dash(spark, d).orders)


@register("audience_growth")
def q_audience_growth(spark, d):
    t = _dash(spark, d)
    return dl.audience_growth(t.user_actions, t.courier_actions)


@register("audience_growth_rates")
def q_audience_growth_rates(spark, d):
    t = _dash(spark, d)
    return dl.audience_growth_rates(t.user_actions, t.courier_actions)


# ----------------------------------------------------------------- economics


@register("daily_revenue")
def q_daily_revenue(spark, d):
    t = _dash(spark, d)
    return ec.daily_revenue(t.orders, t.user_actions, t.products)


@register("arpu_arppu_aov")
def q_arpu_arppu_aov(spark, d):
    t = _dash(spark, d)
    return ec.arpu_arppu_aov(t.orders, t.user_actions, t.products)


@register("product_revenue_share")
def q_product_revenue_share(spark, d):
    t = _dash(spark, d)
    return ec.product_revenue_share(t.orders, t.user_actions, t.products)


@register("new_vs_old_revenue")
def q_new_vs_old_revenue(spark, d):
    t = _dash(spark, d)
    return ec.new_vs_old_revenue(t.user_actions, t.orders, t.products)


@register("vat_extract")
def q_vat_extract(spark, d):
    t = _dash(spark, d)
    taxed = ec.vat_extract(t.products, t.reduced_vat_names)
    return taxed.select(
        "product_id",
        "name",
        F.col("price").cast("double").alias("price"),
        (F.col("tax_cents") / 100.0).alias("tax"),
    )


@register("delivery_cost")
def q_delivery_cost(spark, d):
    t = _dash(spark, d)
    return ec.delivery_cost(
        t.courier_actions, dl.cancelled_orders(t.user_actions), ec.cost_model_frame(spark)
    ).orderBy("date")


@register("packing_cost")
def q_packing_cost(spark, d):
    t = _dash(spark, d)
    return ec.packing_cost(
        t.user_actions, dl.cancelled_orders(t.user_actions), ec.cost_model_frame(spark)
    ).orderBy("date")


@register("courier_bonus")
def q_courier_bonus(spark, d):
    t = _dash(spark, d)
    return ec.courier_bonus(t.courier_actions, ec.cost_model_frame(spark)).orderBy("date")


@register("daily_costs")
def q_daily_costs(spark, d):
    t = _dash(spark, d)
    return ec.daily_costs(t.user_actions, t.courier_actions, ec.cost_model_frame(spark)).orderBy(
        "date"
    )


@register("gross_profit")
def q_gross_profit(spark, d):
    t = _dash(spark, d)
    return ec.gross_profit(
        t.user_actions,
        t.courier_actions,
        t.orders,
        t.products,
        t.reduced_vat_names,
        ec.cost_model_frame(spark),
    )


# ----------------------------------------------------------------- retention

from mercata.operators import retention as rt  # noqa: E402


def _ret(spark: SparkSession, d: str) -> fx.DeliveryTables:
    return fx.delivery_tables(spark, d, fx.RETENTION_PERIOD_DAYS)


@register("activity_date_range")
def q_activity_date_range(spark, d):
    return rt.activity_date_range(_dash(spark, d).user_actions)


@register("active_day_neighbours")
def q_active_day_neighbours(spark, d):
    return rt.active_day_neighbours(_ret(spark, d).user_actions)


@register("retained_vs_churned")
def q_retained_vs_churned(spark, d):
    return rt.retained_vs_churned(_ret(spark, d).user_actions, churn_rule="reference")


@register("retained_vs_churned_gap")
def q_retained_vs_churned_gap(spark, d):
    return rt.retained_vs_churned(_ret(spark, d).user_actions, churn_rule="gap")


@register("user_lifecycle")
def q_user_lifecycle(spark, d):
    return rt.user_lifecycle(_ret(spark, d).user_actions)


@register("user_lifecycle_excluding_cancelled")
def q_user_lifecycle_excluding_cancelled(spark, d):
    return rt.user_lifecycle(_ret(spark, d).user_actions, exclude_action=dl.CANCEL)


@register("most_active_days")
def q_most_active_days(spark, d):
    """The 20 days with the most users of the lifecycle report (top-k)."""
    return rt.user_lifecycle(_ret(spark, d).user_actions).orderBy(F.desc("total"), "day").limit(20)


@register("lag_sanity")
def q_lag_sanity(spark, d):
    return rt.lag_sanity(_ret(spark, d).user_actions)


@register("daily_cohort_retention")
def q_daily_cohort_retention(spark, d):
    return rt.daily_cohort_retention(_ret(spark, d).user_actions)


# -------------------------------------------------------------------- cohort

from mercata.operators import cohort as ch  # noqa: E402
from mercata.operators import quality as ql  # noqa: E402


RETAIL_INDICES = range(1, fx.RETAIL_MONTHS + 1)


def _tx(spark: SparkSession, d: str) -> DataFrame:
    """De-duplicated online-retail lines (the notebooks drop duplicates first)."""
    return ql.dedupe(fx.retail_transactions(spark, d))


@register("cohort_assign")
def q_cohort_assign(spark, d):
    return ch.cohort_assign(_tx(spark, d)).withColumn("UnitPrice", F.col("UnitPrice").cast("double"))


@register("cohort_matrix")
def q_cohort_matrix(spark, d):
    return ch.cohort_matrix(_tx(spark, d))


@register("cohort_matrix_wide")
def q_cohort_matrix_wide(spark, d):
    return ch.cohort_matrix_wide(_tx(spark, d), RETAIL_INDICES)


@register("cohort_retention_wide")
def q_cohort_retention_wide(spark, d):
    return ch.cohort_retention_wide(_tx(spark, d), RETAIL_INDICES)


@register("cohort_reconcile")
def q_cohort_reconcile(spark, d):
    return ch.cohort_reconcile(_tx(spark, d))


@register("cohort_retention_rate")
def q_cohort_retention_rate(spark, d):
    return ch.cohort_retention_rate(_tx(spark, d))


@register("cohort_heatmap_frame")
def q_cohort_heatmap_frame(spark, d):
    return _r(ch.cohort_heatmap_frame(_tx(spark, d)), 9)


@register("tx_time_span")
def q_tx_time_span(spark, d):
    return ch.tx_time_span(_tx(spark, d))


# ------------------------------------------------------------------- quality


def _raw_tx(spark: SparkSession, d: str) -> DataFrame:
    return fx.retail_transactions(spark, d).withColumn("UnitPrice", F.col("UnitPrice").cast("double"))


#: Places of rows that a report leaves out.
DROPPED_ROWS = (0, 523, 5323)


@register("null_profile")
def q_null_profile(spark, d):
    return ql.null_profile(fx.retail_transactions(spark, d))


@register("duplicate_rows")
def q_duplicate_rows(spark, d):
    return ql.duplicate_rows(_raw_tx(spark, d), keep=False, sort_by=["InvoiceNo", "InvoiceDate"])


@register("duplicate_rows_later")
def q_duplicate_rows_later(spark, d):
    return ql.duplicate_rows(_raw_tx(spark, d), keep="first")


@register("dedupe")
def q_dedupe(spark, d):
    return ql.dedupe(_raw_tx(spark, d))


@register("dedupe_stored")
def q_dedupe_stored(spark, d):
    """S10 over a stored table: what was ordered of which supplier, and how it stands."""
    lines = fx.read_table(spark, d, "lineitem")
    return ql.dedupe_stored(lines.select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))


@register("describe_numeric")
def q_describe_numeric(spark, d):
    return _r(ql.describe_numeric(fx.retail_transactions(spark, d), ["Quantity", "UnitPrice"]))


@register("price_outliers")
def q_price_outliers(spark, d):
    return ql.outlier_rows(_raw_tx(spark, d), "UnitPrice", fx.PRICE_OUTLIER)


@register("quantity_outliers")
def q_quantity_outliers(spark, d):
    return ql.outlier_rows(_raw_tx(spark, d), "Quantity", fx.QUANTITY_OUTLIER)


@register("drop_outlier_rows")
def q_drop_outlier_rows(spark, d):
    """The price outliers, removed as listed rows rather than by a predicate."""
    tx = _raw_tx(spark, d)
    return ql.drop_rows(tx, ql.outlier_rows(tx, "UnitPrice", fx.PRICE_OUTLIER).distinct())


@register("drop_row_at")
def q_drop_row_at(spark, d):
    """The orders without the rows at three places of the table."""
    return tb.drop_row_at(spark, DROPPED_ROWS, f"{d.rstrip('/')}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")


@register("invoice_timestamps")
def q_invoice_timestamps(spark, d):
    """Invoice times parsed from text, lines counted per day."""
    tx = tb.to_timestamp_column(fx.retail_export(spark, d), "InvoiceDate", "yyyy-MM-dd HH:mm:ss")
    per_day = tx.groupBy(F.to_date("InvoiceDate").alias("day"))
    return per_day.agg(F.count(F.lit(1)).alias("lines"), F.max("InvoiceDate").alias("last_invoice")).orderBy("day")


@register("ab_export_columns")
def q_ab_export_columns(spark, d):
    """The export without its index column, spaces out of the names."""
    return tb.snake_columns(fx.ab_export(spark, d).drop("Unnamed: 0"))


# ----------------------------------------------------------------------- rfm

from mercata.operators import rfm as rf  # noqa: E402


def _rfm_tx(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned lines with TotalSum: price outliers removed (the reference
    drops its one outlier row by index), duplicates dropped."""
    tx = ql.drop_outliers(fx.retail_transactions(spark, d), "UnitPrice", fx.PRICE_OUTLIER)
    return rf.with_line_total(ql.dedupe(tx))


def _rfm(spark: SparkSession, d: str, reused: bool = False) -> DataFrame:
    """Customer-level R, F, M; checkpointed when the report references it
    several times (quantile edges, scoring, k-means features and labels)."""
    rfm = rf.rfm_matrix(_rfm_tx(spark, d))
    return materialize(rfm) if reused else rfm


def _coded(spark: SparkSession, d: str) -> DataFrame:
    return rf.rfm_code(rf.rfm_scores(_rfm(spark, d, reused=True)))


@register("line_total")
def q_line_total(spark, d):
    return _rfm_tx(spark, d).select(
        "InvoiceNo", "StockCode", "CustomerID", F.col("TotalSum").cast("double").alias("TotalSum")
    )


@register("line_total_profile")
def q_line_total_profile(spark, d):
    return _r(ql.describe_numeric(_rfm_tx(spark, d), ["TotalSum"]))


@register("line_total_p99")
def q_line_total_p99(spark, d):
    return _r(ql.quantile(_rfm_tx(spark, d), "TotalSum", 0.99, "p99"))


@register("snapshot_date")
def q_snapshot_date(spark, d):
    return rf.snapshot_date(_rfm_tx(spark, d))


@register("rfm_matrix")
def q_rfm_matrix(spark, d):
    return _rfm(spark, d)


@register("rfm_anonymous_lines")
def q_rfm_anonymous_lines(spark, d):
    return rf.anonymous_lines(_rfm_tx(spark, d))


@register("rfm_undefined_logs")
def q_rfm_undefined_logs(spark, d):
    return rf.undefined_logs(_rfm(spark, d))


@register("rfm_log")
def q_rfm_log(spark, d):
    return _r(rf.rfm_log(_rfm(spark, d)), 9)


@register("rfm_standardize")
def q_rfm_standardize(spark, d):
    return _r(rf.rfm_standardize(rf.rfm_log(_rfm(spark, d))), 6)


@register("kmeans_total_inertia")
def q_kmeans_total_inertia(spark, d):
    """R6 at k = 1, which needs no fit."""
    return _r(rf.total_inertia(rf.rfm_standardize(rf.rfm_log(_rfm(spark, d)))), 3)


@register("kmeans_elbow")
def q_kmeans_elbow(spark, d):
    return rf.kmeans_elbow(rf.rfm_standardize(rf.rfm_log(_rfm(spark, d))))


@register("kmeans_certificate")
def q_kmeans_certificate(spark, d):
    """R7 for three and four clusters: the labels are a k-means solution."""
    scaled = rf.rfm_standardize(rf.rfm_log(_rfm(spark, d, reused=True)))
    rows = rf.kmeans_certificate(scaled, 3).unionByName(rf.kmeans_certificate(scaled, 4))
    return rows.select("k", "customers", "clusters", "misplaced", "centres_off", F.round("total", 3).alias("total"), "decomposed")


@register("kmeans_elbow_certificate")
def q_kmeans_elbow_certificate(spark, d):
    return rf.kmeans_elbow_certificate(rf.rfm_standardize(rf.rfm_log(_rfm(spark, d, reused=True))))


def _segments(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    rfm = _rfm(spark, d, reused=True)
    seg = rf.kmeans_segments(rfm, rf.rfm_standardize(rf.rfm_log(rfm)), k=k)
    return rfm.join(seg, "CustomerID")


@register("kmeans_segments")
def q_kmeans_segments(spark, d):
    return _segments(spark, d).select("CustomerID", "cluster")


@register("kmeans_profile")
def q_kmeans_profile(spark, d):
    return _r(rf.cluster_profile(_segments(spark, d), "cluster"))


@register("kmeans_profile_four")
def q_kmeans_profile_four(spark, d):
    return _r(rf.cluster_profile(_segments(spark, d, 4), "cluster"))


@register("cluster_sizes")
def q_cluster_sizes(spark, d):
    return rf.cluster_sizes(_segments(spark, d), "cluster")


@register("cluster_mean_bars")
def q_cluster_mean_bars(spark, d):
    return _r(rf.cluster_mean_bars(_segments(spark, d), "cluster"))


@register("rfm_scores")
def q_rfm_scores(spark, d):
    return rf.rfm_scores(_rfm(spark, d, reused=True))


@register("rfm_code")
def q_rfm_code(spark, d):
    return _coded(spark, d)


@register("cluster_profile")
def q_cluster_profile(spark, d):
    return _r(rf.cluster_profile(_coded(spark, d), "RFM_cluster"))


@register("score_mean_bars")
def q_score_mean_bars(spark, d):
    return _r(rf.cluster_mean_bars(_coded(spark, d), "RFM_score"))


@register("cluster_mean_bars_bootstrap")
def q_cluster_mean_bars_bootstrap(spark, d):
    return _r(rf.cluster_mean_bars_bootstrap(_coded(spark, d), "RFM_score"))


@register("rfm_code_count")
def q_rfm_code_count(spark, d):
    return rf.rfm_code_count(_coded(spark, d))


@register("rfm_code_frequency")
def q_rfm_code_frequency(spark, d):
    return rf.rfm_code_frequency(_coded(spark, d))


@register("rfm_segment_label")
def q_rfm_segment_label(spark, d):
    return rf.rfm_segment_label(_coded(spark, d)).select(
        "CustomerID", "RFM_cluster", "RFM_score", "segment"
    )


def _density(df: DataFrame) -> DataFrame:
    return rf.rfm_density(df).withColumns({"x": F.round("x", 6), "value": F.round("value", 9)})


@register("rfm_density")
def q_rfm_density(spark, d):
    return _density(_rfm(spark, d))


@register("rfm_density_log")
def q_rfm_density_log(spark, d):
    return _density(rf.rfm_log(_rfm(spark, d)))


@register("rfm_density_exact")
def q_rfm_density_exact(spark, d):
    return rf.rfm_density_exact(_rfm(spark, d, reused=True)).withColumns({"x": F.round("x", 6), "density": F.round("density", 14)})


@register("rfm_density_exact_log")
def q_rfm_density_exact_log(spark, d):
    logs = rf.rfm_log(_rfm(spark, d, reused=True))
    return rf.rfm_density_exact(logs).withColumns({"x": F.round("x", 6), "density": F.round("density", 14)})


@register("rfm_code_sizes")
def q_rfm_code_sizes(spark, d):
    return rf.cluster_sizes(_coded(spark, d), "RFM_cluster")


# ---------------------------------------------------------------- experiment

from mercata.operators import experiment as ab  # noqa: E402


def _ab(spark: SparkSession, d: str) -> DataFrame:
    return fx.ab_experiment(spark, d)


def _ab2(spark: SparkSession, d: str) -> DataFrame:
    return ab.ab_trim(_ab(spark, d))


@register("ab_outlier_profile")
def q_ab_outlier_profile(spark, d):
    return _r(ab.ab_outlier_profile(_ab(spark, d)))


@register("ab_trim")
def q_ab_trim(spark, d):
    return _ab2(spark, d)


@register("ab_category_counts")
def q_ab_category_counts(spark, d):
    return ab.ab_category_counts(_ab2(spark, d))


@register("ab_conversion_overall")
def q_ab_conversion_overall(spark, d):
    return _r(ab.ab_conversion_overall(_ab2(spark, d)), 12)


@register("ab_conversion_by_group")
def q_ab_conversion_by_group(spark, d):
    return _r(ab.ab_conversion_by_group(_ab2(spark, d)), 12)


@register("ab_effect_size")
def q_ab_effect_size(spark, d):
    return _r(ab.ab_effect_size(_ab2(spark, d)), 9)


@register("ab_exposure_balance")
def q_ab_exposure_balance(spark, d):
    return _r(ab.ab_exposure_balance(_ab2(spark, d)))


@register("ab_day_mix")
def q_ab_day_mix(spark, d):
    return ab.ab_day_mix(_ab(spark, d))


@register("ab_hour_mix")
def q_ab_hour_mix(spark, d):
    return ab.ab_hour_mix(_ab(spark, d))


WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@register("ab_day_mix_wide")
def q_ab_day_mix_wide(spark, d):
    return ch.pivot_wide(ab.ab_day_mix(_ab(spark, d)), ["test_group"], "most_ads_day", "share_pct", WEEKDAYS, "")


@register("ab_hour_mix_wide")
def q_ab_hour_mix_wide(spark, d):
    return ch.pivot_wide(ab.ab_hour_mix(_ab(spark, d)), ["test_group"], "most_ads_hour", "share_pct", range(24), "h")


def _abs(spark: SparkSession, d: str) -> DataFrame:
    return ab.ab_trim(fx.ab_experiments(spark, d), by=["experiment"])


@register("ab_effect_size_by_experiment")
def q_ab_effect_size_by_experiment(spark, d):
    return _r(ab.ab_effect_size(_abs(spark, d), ["experiment"]), 9)


@register("ab_required_n_by_experiment")
def q_ab_required_n_by_experiment(spark, d):
    return _r(ab.ab_required_n(_abs(spark, d), ["experiment"]), 6)


@register("ab_ztest_by_experiment")
def q_ab_ztest_by_experiment(spark, d):
    return _r(ab.ab_ztest(_abs(spark, d), ["experiment"]), 9)


@register("ab_null_distribution_by_experiment")
def q_ab_null_distribution_by_experiment(spark, d):
    return _r(ab.ab_null_distribution(_abs(spark, d), ["experiment"]), 9)


@register("ab_normality_check")
def q_ab_normality_check(spark, d):
    return ab.ab_normality_check(_ab2(spark, d))


@register("ab_group_sizes")
def q_ab_group_sizes(spark, d):
    return ab.ab_group_sizes(_ab2(spark, d))


@register("ab_required_n")
def q_ab_required_n(spark, d):
    return _r(ab.ab_required_n(_ab2(spark, d)), 6)


@register("ab_required_n_t")
def q_ab_required_n_t(spark, d):
    return _r(ab.ab_required_n_t(_ab2(spark, d)), 5)


@register("ab_required_n_t_by_experiment")
def q_ab_required_n_t_by_experiment(spark, d):
    return _r(ab.ab_required_n_t(_abs(spark, d), ["experiment"]), 5)


@register("ab_power_t")
def q_ab_power_t(spark, d):
    return _r(ab.ab_power_t(_ab2(spark, d)), 8)


@register("ab_power_t_by_experiment")
def q_ab_power_t_by_experiment(spark, d):
    return _r(ab.ab_power_t(_abs(spark, d), ["experiment"]), 8)


@register("ab_ztest")
def q_ab_ztest(spark, d):
    return _r(ab.ab_ztest(_ab2(spark, d)), 9)


@register("ab_ztest_pvalue")
def q_ab_ztest_pvalue(spark, d):
    return _r(ab.ab_ztest_pvalue(_ab2(spark, d)), 9)


@register("ab_power")
def q_ab_power(spark, d):
    return _r(ab.ab_power(_ab2(spark, d)), 9)


@register("ab_null_distribution")
def q_ab_null_distribution(spark, d):
    return _r(ab.ab_null_distribution(_ab2(spark, d)), 9)


@register("ab_null_curve")
def q_ab_null_curve(spark, d):
    return _r(ab.ab_null_curve(_ab2(spark, d)), 6, ["pdf"]).withColumn("x", F.round("x", 12))


@register("ab_exposure_histogram")
def q_ab_exposure_histogram(spark, d):
    return _r(ql.histogram_frame(_ab(spark, d), "total_ads", 30), 9)


@register("ab_exposure_histogram_auto")
def q_ab_exposure_histogram_auto(spark, d):
    return _r(ql.histogram_auto(_ab(spark, d), "total_ads"), 9)


@register("ab_exposure_histogram_auto_trimmed")
def q_ab_exposure_histogram_auto_trimmed(spark, d):
    return _r(ql.histogram_auto(_ab2(spark, d), "total_ads"), 9)


@register("rfm_monetary_histogram_auto")
def q_rfm_monetary_histogram_auto(spark, d):
    return _r(ql.histogram_auto(_rfm(spark, d, reused=True), "MonetaryValue"), 6)


@register("ab_exposure_describe")
def q_ab_exposure_describe(spark, d):
    return _r(ql.describe_numeric(_ab(spark, d), ["total_ads"]))


# ------------------------------------------------------------------ campaign

from mercata.operators import campaign as cp  # noqa: E402
from mercata.operators import product as pr  # noqa: E402


def _campaign_inputs(spark: SparkSession, d: str):
    t = _dash(spark, d)
    users, spend = fx.campaign_tables(spark, t.user_actions)
    return users, t.user_actions, t.orders, t.products, spend


@register("campaign_cac")
def q_campaign_cac(spark, d):
    return cp.campaign_cac(*_campaign_inputs(spark, d))


@register("campaign_roi")
def q_campaign_roi(spark, d):
    return cp.campaign_roi(*_campaign_inputs(spark, d))


@register("campaign_aov")
def q_campaign_aov(spark, d):
    return cp.campaign_aov(*_campaign_inputs(spark, d))


@register("campaign_retention")
def q_campaign_retention(spark, d):
    users, actions, *_ = _campaign_inputs(spark, d)
    return cp.campaign_retention(users, actions)


@register("campaign_arppu")
def q_campaign_arppu(spark, d):
    return cp.campaign_arppu(*_campaign_inputs(spark, d))


@register("campaign_payback")
def q_campaign_payback(spark, d):
    return cp.campaign_payback(*_campaign_inputs(spark, d))


# ------------------------------------------------------------------- product


@register("dau_wau_mau")
def q_dau_wau_mau(spark, d):
    return pr.dau_wau_mau(fx.events(spark, d))


@register("engagement_ctr")
def q_engagement_ctr(spark, d):
    return pr.engagement_ctr(fx.events(spark, d))


@register("active_users_rollup")
def q_active_users_rollup(spark, d):
    return pr.active_users_rollup(fx.events(spark, d))


@register("audience_cube")
def q_audience_cube(spark, d):
    tables = (fx.read_table(spark, d, t) for t in ("customer", "nation", "region"))
    return pr.audience_cube(fx.events(spark, d), *tables)


@register("audience_slices")
def q_audience_slices(spark, d):
    users = pr.event_users_with_profile(
        fx.events(spark, d),
        fx.read_table(spark, d, "customer"),
        fx.read_table(spark, d, "nation"),
        fx.read_table(spark, d, "region"),
    )
    return pr.audience_slices(users, ["segment", "nation", "region"])


@register("ab_exposure_histogram_trimmed")
def q_ab_exposure_histogram_trimmed(spark, d):
    return _r(ql.histogram_frame(_ab2(spark, d), "total_ads", 30), 9)


@register("ab_exposure_describe_trimmed")
def q_ab_exposure_describe_trimmed(spark, d):
    return _r(ql.describe_numeric(_ab2(spark, d), ["total_ads"]))
