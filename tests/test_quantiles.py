"""Exact distributed quantiles equal numpy's linear interpolation."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercata.functions.quantiles import FEW, candidates, exact_quantiles, ordered_bits, quantile_bins, value_counts

PROBS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]


def _check(spark, values, probs, groups=None):
    if groups is None:
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = exact_quantiles(df, "x", probs).collect()[0]
        want = np.quantile(np.array(values, dtype=float), probs)
        assert np.allclose(list(got), want, rtol=1e-12, atol=1e-9), (list(got), want)
        return
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)], "g string, x double")
    rows = {r.g: list(r)[1:] for r in exact_quantiles(df, "x", probs, by=["g"]).collect()}
    for g in set(groups):
        vals = np.array([v for gg, v in zip(groups, values) if gg == g], dtype=float)
        assert np.allclose(rows[g], np.quantile(vals, probs), rtol=1e-12, atol=1e-9)


def test_ties_and_a_long_tail(spark):
    rng = np.random.default_rng(7)
    values = list(rng.integers(0, 40, 3000)) + list(rng.normal(0, 1, 2000)) + list(10.0 ** rng.uniform(0, 12, 500))
    _check(spark, values, PROBS)


def test_groups(spark):
    rng = np.random.default_rng(11)
    groups = list(rng.choice(["a", "b", "c"], 4000, p=[0.7, 0.2, 0.1]))
    values = list(rng.exponential(3.0, 4000).round(1))
    _check(spark, values, [0.25, 0.5, 0.75, 0.99], groups=groups)


def test_one_value_holds_nine_tenths(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(F.lit(5.0)).alias("x")
    )
    values = np.where(np.arange(200_000) % 10 == 0, np.arange(200_000), 5.0)
    got = exact_quantiles(df, "x", [0.001, 0.5, 0.95, 0.999]).collect()[0]
    assert np.allclose(list(got), np.quantile(values, [0.001, 0.5, 0.95, 0.999]))


def test_more_than_a_million_values(spark):
    n = 1_300_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(1_299_709)) / 3.0).alias("x"))
    values = (np.arange(n, dtype=np.int64) * 7919 % 1_299_709) / 3.0
    got = exact_quantiles(df, "x", [0.01, 0.5, 0.99]).collect()[0]
    assert np.allclose(list(got), np.quantile(values, [0.01, 0.5, 0.99]), rtol=1e-12)


def test_nulls_nans_and_empty_groups(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", 3.0), ("a", nan), ("b", None), (None, 2.0)], "g string, x double"
    )
    rows = {r.g: r.q50 for r in exact_quantiles(df.where("g IS NOT NULL"), "x", [0.5], ["q50"], by=["g"]).collect()}
    assert rows == {"a": 2.0, "b": None}
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, "x", [0.5], ["q"]).collect()[0].q is None


def test_a_null_value_has_no_bin(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.5,), (9.0,)], "x double")
    edges = [F.lit(v) for v in (0.0, 1.0, 3.0, 9.0)]
    assert [r[0] for r in df.select(quantile_bins(F.col("x"), edges)).collect()] == [None, 1, 2, 3]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_matches_numpy_small(spark, values):
    _check(spark, values, [0.0, 1 / 3, 0.5, 2 / 3, 0.99, 1.0])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny(spark, n):
    _check(spark, list(range(n)), PROBS)


def test_bits_order_like_the_double(spark):
    import math
    import struct

    rng = np.random.default_rng(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), -float("inf")]
    for e in range(-1022, 1024, 31):
        values += [math.ldexp(1.0, e), math.nextafter(math.ldexp(1.0, e), 0), -math.nextafter(math.ldexp(1.0, e), math.inf)]
    values += list(rng.normal(0, 1, 300)) + list(10.0 ** rng.uniform(-300, 300, 300))
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for x, bits in df.select("x", ordered_bits(F.col("x"))).collect():
        pattern = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert bits == (-pattern if x < 0 else pattern), x


def test_a_far_outlier_leaves_few_values_to_the_window(spark):
    """One value of 1e12 among 200,000 distinct ones below 10,000: no window sorts more than FEW of them."""
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") == 7, F.lit(1e12)).otherwise(F.col("id") / F.lit(20.0)).alias("x"))
    values = np.arange(n) / 20.0
    values[7] = 1e12
    probs = [0.0, 0.25, 0.5, 0.99, 0.999995, 1.0]
    got = list(exact_quantiles(df, "x", probs).first())
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12)
    left = candidates(value_counts(df, "x"), probs)
    sizes = [r["count"] for r in left.groupBy("_t.i").count().collect()]
    assert len(sizes) == 2 * len(probs) and max(sizes) <= FEW


def test_selection_goes_on_to_the_last_bits(spark):
    """Values that differ in their lowest bits only."""
    n = 20_000
    df = spark.range(n).select((F.lit(1.0) + F.col("id") * F.lit(2.0**-52)).alias("x"))
    got = list(exact_quantiles(df, "x", [0.0, 0.5, 1.0]).first())
    assert got[0] == 1.0 and got[2] == 1.0 + (n - 1) * 2.0**-52
    assert abs(got[1] - (1.0 + (n - 1) / 2 * 2.0**-52)) <= 2.0**-52
