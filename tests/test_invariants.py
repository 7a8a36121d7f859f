"""Cross-report invariants (the reference's inline checks, and more)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from mercata.plans.registry import QUERIES


def q(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)


def test_lifecycle_partitions_total(spark, sf_dir):
    for r in q(spark, sf_dir, "user_lifecycle").collect():
        assert r.new_users + r.retained_users + r.returned_users + r.resurrected_users == r.total


def test_retained_agrees_between_reports(spark, sf_dir):
    a = {r.day: r.retained_users for r in q(spark, sf_dir, "user_lifecycle").collect()}
    b = {r.day: r.retained_users for r in q(spark, sf_dir, "retained_vs_churned").collect()}
    assert a == b


def test_revenue_totals_agree(spark, sf_dir):
    daily = q(spark, sf_dir, "daily_revenue").collect()
    total = round(sum(r.revenue for r in daily), 2)
    assert round(daily[-1].total_revenue, 2) == total
    shares = q(spark, sf_dir, "product_revenue_share").collect()
    assert round(sum(r.revenue for r in shares), 2) == total


def test_new_and_old_shares_sum_to_100(spark, sf_dir):
    for r in q(spark, sf_dir, "new_vs_old_revenue").collect():
        if r.new_users_revenue_share is not None:
            assert round(r.new_users_revenue_share + r.old_users_revenue_share, 2) == 100.0


def test_cohort_invariants(spark, sf_dir):
    assert q(spark, sf_dir, "cohort_reconcile").collect()[0].reconciled
    for r in q(spark, sf_dir, "cohort_retention_rate").where(F.col("CohortIndex") == 1).collect():
        assert r.retention == 100.0
    for r in q(spark, sf_dir, "daily_cohort_retention").where(F.col("cohort") == F.col("day")).collect():
        assert r.retention == 100


def test_rfm_codes_and_scores(spark, sf_dir):
    rows = q(spark, sf_dir, "rfm_code").collect()
    assert rows and all(3 <= r.RFM_score <= 9 for r in rows)
    assert all(r.RFM_cluster in {f"{a}{b}{c}" for a in "123" for b in "123" for c in "123"} for r in rows)
    assert q(spark, sf_dir, "rfm_code_count").collect()[0].n_codes <= 27


def test_standardized_features(spark, sf_dir):
    df = q(spark, sf_dir, "rfm_standardize")
    for c in ("Recency", "Frequency", "MonetaryValue"):
        m, s = df.agg(F.avg(c), F.stddev_pop(c)).collect()[0]
        assert abs(m) < 1e-5 and abs(s - 1) < 1e-5


def test_crosstab_rows_sum_to_100(spark, sf_dir):
    for name in ("ab_day_mix", "ab_hour_mix"):
        sums = q(spark, sf_dir, name).groupBy("test_group").agg(F.sum("share_pct").alias("s")).collect()
        assert all(abs(r.s - 100) < 0.15 for r in sums)


def test_z_squared_is_chi_square(spark, sf_dir):
    r = q(spark, sf_dir, "ab_ztest").collect()[0]
    a, b = r.conv_control, r.n_control - r.conv_control
    c, d = r.conv_test, r.n_test - r.conv_test
    n = a + b + c + d
    chi2 = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert math.isclose(r.z**2, chi2, rel_tol=1e-6)


def test_pvalue_matches_stdlib(spark, sf_dir):
    r = q(spark, sf_dir, "ab_ztest_pvalue").collect()[0]
    assert math.isclose(r.p_value, math.erfc(abs(r.z) / math.sqrt(2)), abs_tol=1e-8)  # 9 digits


def test_elbow_decreases(spark, sf_dir):
    rows = q(spark, sf_dir, "kmeans_elbow").orderBy("k").collect()
    assert [r.k for r in rows] == list(range(1, 15))
    assert rows[-1].inertia < rows[1].inertia < rows[0].inertia


def test_kmeans_labels_ordered_by_monetary_value(spark, sf_dir):
    prof = q(spark, sf_dir, "kmeans_profile").orderBy("cluster").collect()
    means = [r.MonetaryValue_mean for r in prof]
    assert means == sorted(means) and [r.cluster for r in prof] == [0, 1, 2]


def test_same_result_with_1_and_64_partitions(spark, sf_dir):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return sorted(map(tuple, q(spark, sf_dir, "gross_profit").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert run(1) == run(64)


def test_dedupe_leaves_no_duplicates(spark, sf_dir):
    from mercata.operators.quality import dedupe, duplicate_rows
    from mercata.sources.fixtures import retail_transactions

    tx = retail_transactions(spark, sf_dir)
    assert duplicate_rows(tx).count() > 0
    assert duplicate_rows(dedupe(tx)).count() == 0
