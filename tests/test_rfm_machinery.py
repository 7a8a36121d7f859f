"""Bootstrap bars, exact density, k-means certificates, data-driven bins and user bitmaps against numpy and plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.functions.hashing import mix
from mercata.operators import product as pr
from mercata.operators import quality as ql
from mercata.operators import rfm as rf

M32 = 2**32 - 1


def plain_mix(x: int) -> int:
    x = (x ^ (x >> 32)) & M32
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 0x45D9F3B) & M32
    return x ^ (x >> 16)


def test_mix_is_the_plain_hash(spark):
    xs = [0, 1, 2, 12345, 2**31, 2**32 - 1, 2**40 + 7, 2**62 + 3]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(mix(F.col("x"))).collect()]
    assert got == [plain_mix(x) for x in xs]


def test_bootstrap_intervals_cover_the_mean(spark):
    """Sixty clusters of a skewed variable of known mean: about 95 % of the intervals hold it."""
    rng = np.random.default_rng(8)
    rows = [(int(i), c, float(v), 1.0, 5.0) for c in range(60) for i, v in zip(range(c * 1000, c * 1000 + 80), rng.exponential(3.0, 80), strict=True)]
    df = spark.createDataFrame(rows, "CustomerID long, c int, Recency double, Frequency double, MonetaryValue double")
    got = rf.cluster_mean_bars_bootstrap(df, "c", replicates=400).collect()
    recency = [r for r in got if r.metric == "Recency"]
    assert len(got) == 180 and len(recency) == 60
    assert sum(r.ci_low <= 3.0 <= r.ci_high for r in recency) >= 50
    assert all(r.ci_low < r.mean < r.ci_high and r.n == 80 for r in recency)
    assert all(math.isclose(r.ci_low, 1.0) and math.isclose(r.ci_high, 1.0) for r in got if r.metric == "Frequency")
    normal = {r.c: r for r in rf.cluster_mean_bars(df, "c").where("metric = 'Recency'").collect()}
    ratios = [(r.ci_high - r.ci_low) / (normal[r.c].ci_high - normal[r.c].ci_low) for r in recency]
    assert 0.9 < np.mean(ratios) < 1.1


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(i, i % 2, float(i % 17), None if i % 5 else 2.0, float(i)) for i in range(300)] + [(None, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "CustomerID long, c int, Recency double, Frequency double, MonetaryValue double")
    key = lambda d: [(r.c, r.metric, r.n, round(r.ci_low, 9), round(r.ci_high, 9)) for r in rf.cluster_mean_bars_bootstrap(d, "c", replicates=50).collect()]
    assert key(df.coalesce(1)) == key(df.repartition(7))
    assert [r[2] for r in key(df) if r[0] == 0 and r[1] == "Frequency"] == [30]


def test_exact_density_is_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.lognormal(0, 1.5, 700), [4000.0, -30.0]])
    b = rng.integers(0, 9, len(a)).astype(float)
    df = spark.createDataFrame([(float(x), float(y), 3.0) for x, y in zip(a, b, strict=True)] + [(None, 1.0, None)], "a double, b double, flat double")
    got = rf.rfm_density_exact(df, ["a", "b", "flat"], grid=60).collect()
    assert {r.metric for r in got} == {"a", "b"}
    for name, values in (("a", a), ("b", np.append(b, 1.0))):
        h = values.std(ddof=1) * len(values) ** -0.2
        rows = sorted((r.x, r.density) for r in got if r.metric == name)
        assert len(rows) == 60
        for x, density in rows:
            want = np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
            assert abs(density - want) <= 1e-13 / h


def edges_of(values):
    """numpy's edges for the narrower of the two widths; Sturges alone if the quartiles are equal."""
    sturges = np.histogram_bin_edges(values, "sturges")
    if not np.subtract(*np.percentile(values, [75, 25])):
        return sturges
    return max(sturges, np.histogram_bin_edges(values, "fd"), key=len)


def test_automatic_bins_are_numpys(spark):
    rng = np.random.default_rng(6)
    cases = [rng.normal(0, 1, 500), rng.exponential(1, 3000), np.array([1.0, 2.0]), np.repeat([5.0, 6.0], [99, 1])]
    for values in cases:
        got = ql.histogram_auto(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double"), "x").collect()
        edges = edges_of(values)
        assert len(got) == len(edges) - 1
        assert np.allclose([r.bin_lo for r in got] + [got[-1].bin_hi], edges)
        assert sum(r.n for r in got) == len(values)
        assert [r.n for r in got] == list(np.histogram(values, edges)[0])


def test_automatic_bins_of_integers_constants_and_nothing(spark):
    whole = ql.histogram_auto(spark.createDataFrame([(i % 5,) for i in range(1000)], "x int"), "x").collect()
    assert [(r.bin_lo, r.n) for r in whole] == [(0.0, 200), (1.0, 200), (2.0, 200), (3.0, 400)]
    flat = ql.histogram_auto(spark.createDataFrame([(7.0,)] * 9, "x double"), "x").collect()
    assert [(r.bin_lo, r.bin_hi, r.n) for r in flat] == [(6.5, 7.5, 9)]
    assert ql.histogram_auto(spark.createDataFrame([(None,)], "x double"), "x").collect() == []


def test_a_far_outlier_makes_rows_not_arrays(spark):
    df = spark.createDataFrame([(float(i % 100),) for i in range(1000)] + [(2e5,)], "x double")
    got = ql.histogram_auto(df, "x")
    n = got.count()
    assert n == len(edges_of(np.array([float(i % 100) for i in range(1000)] + [2e5]))) - 1 > ql.HISTOGRAM_CHUNK
    assert got.agg(F.sum("n")).first()[0] == 1001


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 5, 5))])
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "CustomerID long, Recency double, Frequency double, MonetaryValue double")


def test_certificate_holds_for_a_solution_and_fails_for_others(three):
    cols = list(rf.RFM_COLS)
    right = three.withColumn("cluster", (F.col("CustomerID") / 40).cast("int"))
    means = [list(r)[1:] for r in right.groupBy("cluster").agg(*[F.avg(c) for c in cols]).orderBy("cluster").collect()]
    ok = rf.clustering_certificate(right, means).first()
    assert (ok.customers, ok.clusters, ok.misplaced, ok.centres_off, ok.decomposed) == (120, 3, 0, 0, True)
    moved = right.withColumn("cluster", F.when(F.col("CustomerID") == 0, 1).otherwise(F.col("cluster")))
    assert rf.clustering_certificate(moved, means).first().misplaced >= 1
    assert rf.clustering_certificate(moved, means).first().centres_off == 2
    assert rf.clustering_certificate(right, [[9.0, 9.0, 9.0], *means[1:]]).first().centres_off == 1
    whole = rf.kmeans_certificate(three, 3).first()
    assert (whole.misplaced, whole.centres_off, whole.clusters, whole.decomposed) == (0, 0, 3, True)
    elbow = rf.kmeans_elbow_certificate(three, ks=(1, 2, 3)).collect()
    assert [(r.k, r.customers, r.cost_agrees, r.no_worse) for r in elbow] == [(k, 120, True, True) for k in (1, 2, 3)]


@pytest.fixture(scope="module")
def loose(spark):
    """Customers without clear clusters: single starts of k-means end in solutions of varying worth."""
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(0, 1, (60, 3)), 3)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "CustomerID long, Recency double, Frequency double, MonetaryValue double")


def test_fits_side_by_side_cost_what_single_ones_cost(spark, loose):
    sc, ks = spark.sparkContext, (2, 3, 4, 5)
    feats = rf._features(loose, rf.RFM_COLS).persist()
    try:
        sc.setJobGroup("single fits", "")
        single = {k: rf._best_fit(feats, k, (1, 2, 3), 300).summary.trainingCost for k in ks}
        sc.setJobGroup("elbow", "")
        got = {r.k: r.inertia for r in rf.kmeans_elbow(loose, ks=ks).collect()}
    finally:
        sc._jsc.sc().clearJobGroup()
        feats.unpersist()
    assert got == {k: pytest.approx(cost, rel=1e-6) for k, cost in single.items()}
    # a start takes some jobs of its own, a step none: it shares one with the steps of the other fits
    jobs = lambda group: len(sc.statusTracker().getJobIdsForGroup(group))
    assert jobs("elbow") < jobs("single fits")


def test_no_k_of_the_elbow_costs_more_than_a_smaller_one(loose):
    ks, feats = tuple(range(2, 15)), rf._features(loose, rf.RFM_COLS)
    alone = [rf._best_fit(feats, k, (1,), 300).summary.trainingCost for k in ks]
    assert any(b > a for a, b in zip(alone, alone[1:]))
    costs = [r.inertia for r in rf.kmeans_elbow(loose, ks=ks, seeds=(1,)).orderBy("k").collect()]
    assert all(b <= a for a, b in zip(costs, costs[1:])) and all(b <= a * (1 + 1e-6) for a, b in zip(alone, costs))
    assert all(r.no_worse and r.cost_agrees for r in rf.kmeans_elbow_certificate(loose, ks=ks, seeds=(1,)).collect())


def test_bitmaps_count_like_distinct(spark):
    rng = np.random.default_rng(2)
    rows = [(int(u), *"xyz"[:0], d, g) for u, d, g in zip(rng.integers(-5, 70_000, 4000), rng.choice(["a", "b", None], 4000), rng.choice(["m", "n"], 4000), strict=True)]
    df = spark.createDataFrame(rows + [(None, "a", "m")], "user_id long, d string, g string")
    bitmaps = pr.user_bitmaps(df, ["d", "g"])
    got = pr.merged_users(bitmaps, [["d", "g"], ["d"], []], ["d", "g"]).collect()
    want = df.where("user_id IS NOT NULL").groupingSets([["d", "g"], ["d"], []], "d", "g").agg(F.grouping_id().alias("level"), F.count_distinct("user_id").alias("users"))
    key = lambda rs: sorted(((r.d, r.g, r.level, r.users) for r in rs), key=str)
    assert key(got) == key(want.collect())
    assert pr.merged_users(pr.user_bitmaps(df.limit(0), ["d"]), [["d"]], ["d"]).collect() == []
