"""Student's t and the noncentral t as Columns, against numeric integrals of the standard library."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from mercata.functions import stats
from mercata.operators import experiment as ab


def phi(x):
    return math.erfc(-x / math.sqrt(2)) / 2


def beyond(c, df, d=0.0, steps=4000):
    """P(|T| > c) for noncentrality d: Simpson's rule over the chi-distributed scale."""
    sd = 1 / math.sqrt(2 * df)
    a, b = max(0.0, 1 - 12 * sd), 1 + 14 * sd
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
    total = 0.0
    for i in range(steps + 1):
        s = a + (b - a) * i / steps
        if s > 0:
            weight = 1 if i in (0, steps) else 4 if i % 2 else 2
            total += weight * math.exp(log + (df - 1) * math.log(s) - df * s * s / 2) * (phi(d - c * s) + phi(-d - c * s))
    return total * (b - a) / steps / 3


def critical(alpha, df):
    low, high = 1.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid, df, steps=1000) > alpha else (low, mid)
    return low


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_normal_tail(spark):
    xs = [0.0, 1e-9, 0.5, 1.0, 2.5, 5.0, 7.0, 7.08, 9.0, 20.0, 37.0]
    got = one(spark, *[stats._upper_tail(F.lit(x)) for x in xs])
    for x, g in zip(xs, got, strict=True):
        assert math.isclose(g, math.erfc(x / math.sqrt(2)) / 2, rel_tol=1e-8, abs_tol=2e-15), x


@pytest.mark.parametrize("df", [2.0, 3.0, 7.5, 30.0, 1000.0])
def test_critical_value(spark, df):
    (got,) = one(spark, stats.t_critical(0.05, F.lit(df)))
    assert math.isclose(got, critical(0.05, df), abs_tol=1e-6)


def test_known_critical_values(spark):
    """Closed forms: with 2 degrees of freedom t = (2 p - 1) / sqrt(2 p (1 - p))."""
    p = 0.975
    got = one(spark, stats.t_critical(0.05, F.lit(2)), stats.t_critical(0.05, F.lit(1)), stats.t_critical(0.05, F.lit(None).cast("double")))
    assert math.isclose(got[0], (2 * p - 1) / math.sqrt(2 * p * (1 - p)), rel_tol=1e-9)
    assert got[1:] == [None, None]


@pytest.mark.parametrize("effect, n1, n2", [(0.5, 64, 64), (-0.05, 3000, 9000), (1.2, 5, 9), (3.1, 2, 2), (0.4, 1000, 3000), (0.0, 50, 50)])
def test_power(spark, effect, n1, n2):
    (got,) = one(spark, stats.t_test_power(F.lit(effect), F.lit(n1), F.lit(n2), 0.05))
    want = beyond(critical(0.05, n1 + n2 - 2), n1 + n2 - 2, abs(effect) * math.sqrt(n1 * n2 / (n1 + n2)))
    assert math.isclose(got, want, abs_tol=1e-6)


@pytest.mark.parametrize("effect, ratio", [(0.5, 1.0), (-0.8, 2.0), (2.5, 1.0), (0.0534, 0.25)])
def test_size_has_the_power(spark, effect, ratio):
    n = stats.t_test_size(F.lit(effect), 0.05, 0.8, ratio)
    size, power = one(spark, n, stats.t_test_power(F.lit(effect), n, n * F.lit(ratio), 0.05))
    assert size >= 2 and math.isclose(power, 0.8, abs_tol=1e-10)


def test_size_without_effect_or_far_beyond(spark):
    none, unknown, least = one(
        spark, stats.t_test_size(F.lit(0.0), 0.05, 0.8, 1.0), stats.t_test_size(F.lit(None).cast("double"), 0.05, 0.8, 1.0),
        stats.t_test_size(F.lit(50.0), 0.05, 0.8, 1.0),
    )
    assert none is None and unknown is None and least == 2.0


def test_every_experiment_on_its_own(spark):
    rows = [(e, g, i % (m + (g == "ad")) == 0) for e, m in ((1, 2), (2, 4)) for i in range(60) for g in ("psa", "ad")]
    rows += [(3, "ad", True)] * 5
    df = spark.createDataFrame(rows, "experiment int, test_group string, converted boolean")
    power = {r.experiment: r for r in ab.ab_power_t(df, ["experiment"]).collect()}
    sizes = {r.experiment: r for r in ab.ab_required_n_t(df, ["experiment"]).collect()}
    for e in (1, 2):
        alone = df.where(F.col("experiment") == e).drop("experiment")
        assert math.isclose(ab.ab_power_t(alone).first().power, power[e].power, rel_tol=1e-12)
        assert math.isclose(ab.ab_required_n_t(alone).first().required_n, sizes[e].required_n, rel_tol=1e-12)
        assert sizes[e].required_n > ab.ab_required_n(alone).first().required_n
        assert sizes[e].required_n_ceil == math.ceil(sizes[e].required_n)
    assert power[3].power is None and sizes[3].required_n is None
