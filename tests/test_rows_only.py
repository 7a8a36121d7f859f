"""Reports without a SQL oracle, checked against brute force on small data."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from mercata.operators import experiment as ab
from mercata.operators import rfm as rf
from mercata.plans.registry import QUERIES


def test_binned_kde_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.gamma(2.0, 3.0, 500).round(2)
    df = spark.createDataFrame(
        [(i, int(v * 10), int(v) + 1, float(v)) for i, v in enumerate(vals)],
        "CustomerID bigint, Recency bigint, Frequency bigint, MonetaryValue double",
    )
    out = rf.rfm_density(df, cols=["MonetaryValue"], bins=20, grid=25).collect()
    hist = [r for r in out if r.kind == "histogram"]
    kde = sorted((r.x, r.value) for r in out if r.kind == "kde")
    counts, edges = np.histogram(vals, bins=20)
    assert [int(r.value) for r in sorted(hist, key=lambda r: r.x) if r.value] == [c for c in counts if c]
    centres = (edges[:-1] + edges[1:]) / 2
    bw = vals.std(ddof=1) * len(vals) ** -0.2
    for x, dens in kde:
        want = (counts * np.exp(-0.5 * ((x - centres) / bw) ** 2)).sum() / (len(vals) * bw * math.sqrt(2 * math.pi))
        assert math.isclose(dens, want, rel_tol=1e-9, abs_tol=1e-15)


def test_power_matches_closed_form(spark, sf_dir):
    df = QUERIES["ab_trim"](spark, sf_dir)
    counts = ab.arm_counts(df).collect()[0]
    eff = ab.ab_effect_size(df).collect()[0].effect_size
    n1, n2 = counts.n_control, counts.n_test
    lam = eff * math.sqrt(n1 * n2 / (n1 + n2))
    z = NormalDist().inv_cdf(0.975)
    want = NormalDist().cdf(lam - z) + NormalDist().cdf(-lam - z)
    got = ab.ab_power(df).collect()[0].power
    assert math.isclose(got, want, rel_tol=1e-9)


def test_required_n_matches_closed_form(spark, sf_dir):
    df = QUERIES["ab_trim"](spark, sf_dir)
    h = ab.ab_effect_size(df).collect()[0].effect_size
    z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
    got = ab.ab_required_n(df).collect()[0].required_n
    assert math.isclose(got, 2 * (z / h) ** 2, rel_tol=1e-12)


def test_skewed_user_does_not_change_results(spark):
    """One user holds a third of all actions; reports equal brute force."""
    import datetime as dt

    from mercata.operators import retention as rt
    from mercata.sources.tables import USER_ACTIONS

    rng = np.random.default_rng(5)
    rows = []
    base = dt.datetime(2022, 8, 24)
    for i in range(3000):
        user = 0 if i % 3 == 0 else int(rng.integers(1, 200))
        rows.append((user, i, "create_order", base + dt.timedelta(days=int(rng.integers(0, 40)), minutes=i % 1440)))
    actions = spark.createDataFrame(rows, USER_ACTIONS)
    got = {r.day: (r.total, r.new_users, r.retained_users, r.returned_users, r.resurrected_users)
           for r in rt.user_lifecycle(actions).collect()}
    days = {}
    for u, _, _, t in rows:
        days.setdefault(u, set()).add(t.date())
    want = {}
    for u, ds in days.items():
        prev = None
        for d in sorted(ds):
            gap = None if prev is None else (d - prev).days
            tot, new, ret, rtn, res = want.get(d, (0, 0, 0, 0, 0))
            want[d] = (
                tot + 1,
                new + (gap is None),
                ret + (gap == 1),
                rtn + (gap is not None and 1 < gap < 14),
                res + (gap is not None and gap >= 14),
            )
            prev = d
    assert got == want
    ranked = actions.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()
    assert ranked.user_id == 0 and ranked.n == 1000


def test_many_experiments_in_one_pass(spark, sf_dir):
    """by=[experiment] gives each experiment the numbers it gets alone."""
    base = QUERIES["ab_trim"](spark, sf_dir)
    two = base.withColumn("experiment", F.lit("e1")).unionByName(
        base.where(F.col("user_id") % 3 != 0).withColumn("experiment", F.lit("e2"))
    )
    together = {r.experiment: r for r in ab.ab_ztest(two, by=["experiment"]).collect()}
    alone = ab.ab_ztest(base.where(F.col("user_id") % 3 != 0)).collect()[0]
    assert together["e2"].z == alone.z and together["e2"].n_test == alone.n_test
    eff = {r.experiment: r.effect_size for r in ab.ab_effect_size(two, by=["experiment"]).collect()}
    assert eff["e1"] == ab.ab_effect_size(base).collect()[0].effect_size
    trimmed = ab.ab_trim(two, by=["experiment"]).groupBy("experiment").count().collect()
    assert {r.experiment: r["count"] for r in trimmed}["e1"] == ab.ab_trim(base).count()


def test_join_per_key_equals_a_plain_join_and_spreads_hot_keys(spark):
    """Nine tenths of the rows are equal and share a key; a tenth of the rest has none."""
    from mercata.functions.joins import join_per_key

    rows = [(0, 7) if i % 10 else (None if i % 100 == 0 else i % 500 + 1, i) for i in range(60_000)]
    big = spark.createDataFrame(rows, "k bigint, v bigint")
    per_key = spark.createDataFrame([(k, k * 10) for k in range(0, 400)], "k bigint, w bigint")
    counted = per_key.join(big.groupBy("k").agg(F.count(F.lit(1)).alias("_rows")), "k", "left").fillna(0, ["_rows"])
    for how in ("inner", "left"):
        want = big.join(per_key, ["k"], how).groupBy("k", "v", "w").count().collect()
        got = join_per_key(big, counted, ["k"], how=how).groupBy("k", "v", "w").count().collect()
        assert sorted(map(str, want)) == sorted(map(str, got))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        parts = join_per_key(big, counted, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    sizes = [r["count"] for r in parts]
    assert sum(sizes) == 60_000 and max(sizes) <= 2 * 60_000 / 8


def test_cohort_assign_keeps_lines_without_customer(spark):
    import datetime as dt

    from mercata.operators import cohort as ch

    t = dt.datetime(2011, 1, 5)
    tx = spark.createDataFrame(
        [(1, t), (1, t + dt.timedelta(days=40)), (None, t), (None, t)], "CustomerID bigint, InvoiceDate timestamp_ntz"
    )
    got = sorted((r.CustomerID or 0, r.CohortIndex or 0) for r in ch.cohort_assign(tx).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 2)]
    assert [tuple(r)[1:] for r in ch.cohort_matrix(tx).collect()] == [(1, 1), (2, 1)]


def test_rfm_leaves_out_lines_without_customer_but_not_their_dates(spark):
    import datetime as dt

    t = dt.datetime(2011, 1, 5)
    tx = spark.createDataFrame(
        [(1, 1, t, 5.0), (None, 2, t + dt.timedelta(days=9), 7.0)],
        "CustomerID bigint, InvoiceNo bigint, InvoiceDate timestamp_ntz, TotalSum double",
    )
    assert [tuple(r) for r in rf.rfm_matrix(tx).collect()] == [(1, 10, 1, 5.0)]
    assert tuple(rf.anonymous_lines(tx).first()) == (2, 1)


def test_constant_metric_standardises_to_zero_and_has_no_density(spark):
    df = spark.createDataFrame([(i, 5.0, float(i + 1), 2.0) for i in range(6)], "CustomerID long, Recency double, Frequency double, MonetaryValue double")
    assert {r.Recency for r in rf.rfm_standardize(df).collect()} == {0.0}
    kinds = {(r.metric, r.kind) for r in rf.rfm_density(df, bins=5, grid=5).collect()}
    assert ("Recency", "histogram") in kinds and ("Recency", "kde") not in kinds and ("Frequency", "kde") in kinds


def test_empty_arms_and_equal_rates_give_null_for_their_experiment_only(spark):
    rows = [("both", "psa", True)] + [("both", "psa", False)] * 3 + [("both", "ad", True)] * 2 + [("both", "ad", False)]
    rows += [("one", "ad", i % 2 == 0) for i in range(6)]
    rows += [("same", g, c) for g in ("psa", "ad") for c in (True, False)]
    df = spark.createDataFrame(rows, "experiment string, test_group string, converted boolean")
    by = ["experiment"]
    z = {r.experiment: r.z for r in ab.ab_ztest(df, by).collect()}
    assert z["one"] is None and z["both"] < 0 and z["same"] == 0
    assert {r.experiment: r.required_n is None for r in ab.ab_required_n(df, by).collect()} == {
        "both": False, "one": True, "same": True,
    }
    nd = {r.experiment: r.se_exact for r in ab.ab_null_distribution(df, by).collect()}
    assert nd["one"] is None and nd["both"] > 0
    assert {r.experiment for r in ab.ab_null_curve(df, by, points=5).collect()} == {"both", "same"}
    assert {r.experiment: r.p_value is None for r in ab.ab_ztest_pvalue(df, by).collect()}["one"]
    assert {r.experiment: r.power is None for r in ab.ab_power(df, by).collect()}["one"]


def test_null_curve_of_a_million_users_an_arm(spark):
    df = spark.range(2_000_000).select(
        F.when(F.col("id") % 2 == 0, "psa").otherwise("ad").alias("test_group"), (F.col("id") % 41 == 0).alias("converted")
    )
    curve = ab.ab_null_curve(df, points=101).collect()
    assert len(curve) == 101 and all(r.pdf > 0 for r in curve)
    tail = [r.in_rejection for r in curve]
    assert tail[0] and tail[-1] and not tail[50]


def test_erfc_matches_the_standard_library(spark):
    from mercata.functions.stats import erfc

    xs = [-6.0, -2.9, -0.3, 0.0, 1e-9, 0.5, 1.7, 2.99, 3.0, 3.01, 5.0, 9.0, 20.0]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    got = {r.x: r.y for r in df.select("x", erfc(F.col("x")).alias("y")).collect()}
    assert got[None] is None
    assert all(math.isclose(got[x], math.erfc(x), rel_tol=1e-10) for x in xs)


def test_kmeans_labels_do_not_follow_the_shuffle_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.lognormal(1.0, 1.0, 3))) for i in range(400)]
    rfm = spark.createDataFrame(rows, "CustomerID long, Recency double, Frequency double, MonetaryValue double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in ("4", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spread = rfm.repartition(int(n))
            seg = rf.kmeans_segments(spread, rf.rfm_standardize(rf.rfm_log(spread)), seeds=(1, 2))
            seen.add(tuple(sorted((r.CustomerID, r.cluster) for r in seg.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_campaign_aov_is_the_mean_of_users_means(spark):
    import datetime as dt

    from mercata.operators import campaign as cp

    t = dt.datetime(2022, 8, 24)
    actions = spark.createDataFrame(
        [(1, 10, "create_order", t), (1, 11, "create_order", t), (2, 12, "create_order", t), (3, 13, "create_order", t)],
        "user_id long, order_id long, action string, time timestamp_ntz",
    )
    orders = spark.createDataFrame(
        [(10, t, [1]), (11, t, [1, 1]), (12, t, [2]), (13, t, [])], "order_id long, creation_time timestamp_ntz, product_ids array<long>"
    )
    products = spark.createDataFrame([(1, "a", 1.0), (2, "b", 9.0)], "product_id long, name string, price double").withColumn(
        "price", F.col("price").cast("decimal(12,2)")
    )
    users = spark.createDataFrame([("c", 1), ("c", 2), ("organic", 3)], "campaign string, user_id long")
    spend = spark.createDataFrame([("c", 5)], "campaign string, amount bigint")
    got = {r.campaign: r for r in cp.campaign_aov(users, actions, orders, products, spend).collect()}
    assert got["c"].aov == round((1.5 + 9.0) / 2, 2) and got["c"].revenue_per_order == 4.0
    assert got["organic"].aov == 0.0 and got["organic"].n_orders == 1
    cac = {r.campaign: (r.spend, r.cac) for r in cp.campaign_cac(users, actions, orders, products, spend).collect()}
    assert cac["organic"] == (None, None) and cac["c"][0] == 5
