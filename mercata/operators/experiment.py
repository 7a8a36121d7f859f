"""A/B conversion experiments.

Two distributed passes do the heavy work: an exact p99 of exposure per
experiment (to trim outliers) and one grouped aggregate of arm sizes and
conversions. Every statistic after that is Column arithmetic on one row
per experiment, so ``by=[experiment keys]`` runs any number of experiments
in the same jobs. Defaults follow the reference: groups ``psa`` (control)
and ``ad`` (test), exposure ``total_ads``, two-sided alpha 0.05, power 0.8.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.joins import attach
from mercata.functions.quantiles import exact_quantiles, quantiles_of_counts, value_counts
from mercata.functions.rounding import round_ratio, round_ratio_units, units_to_double
from mercata.functions.stats import normal_cdf, t_test_power, t_test_size, two_sided_p, z_quantile

GROUP = "test_group"
CONVERTED = "converted"
EXPOSURE = "total_ads"
CONTROL = "psa"
TEST = "ad"
TRIM_Q = 0.99
ALPHA = 0.05
POWER = 0.8
# Fixed values of the reference: Cohen's h magnitude thresholds.
EFFECT_LARGE, EFFECT_MEDIUM, EFFECT_SMALL = 0.8, 0.5, 0.2
NULL_CURVE_POINTS = 1000
NULL_CURVE_HALF_WIDTH_SE = 8.5


def exposure_threshold(df: DataFrame, q: float = TRIM_Q, by: Sequence[str] = (), col: str = EXPOSURE) -> DataFrame:
    """Exact q-quantile of exposure per experiment (column ``threshold``)."""
    return exact_quantiles(df, col, [q], ["threshold"], by=by)


def ab_outlier_profile(df: DataFrame, q: float = TRIM_Q, by: Sequence[str] = (), col: str = EXPOSURE) -> DataFrame:
    """A1: rows above the q-quantile: mean / min / max exposure per group."""
    t = attach(df, exposure_threshold(df, q, by, col), by)
    return (
        t.where(F.col(col) > F.col("threshold"))
        .groupBy(*by, GROUP)
        .agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
        .orderBy(*by, GROUP)
    )


def ab_trim(df: DataFrame, q: float = TRIM_Q, by: Sequence[str] = (), col: str = EXPOSURE) -> DataFrame:
    """A2: keep rows strictly below the q-quantile (rows equal to it are in
    neither the trimmed frame nor the outlier profile, as in the reference)."""
    t = attach(df, exposure_threshold(df, q, by, col), by)
    return t.where(F.col(col) < F.col("threshold")).select(*df.columns)


def ab_category_counts(
    df: DataFrame, cols: Sequence[str] = (GROUP, CONVERTED, "most_ads_day", "most_ads_hour")
) -> DataFrame:
    """A3: value counts of categorical columns as (column_name, value, n)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value"
    )
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "column_name", F.desc("n"), "value"
    )


def ab_conversion_overall(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4: share of converted / not converted rows."""
    c = df.groupBy(*by, CONVERTED).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy())
    return c.select(*by, CONVERTED, (F.col("n").cast("double") / total).alias("share")).orderBy(
        *by, CONVERTED
    )


def ab_conversion_by_group(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A5: n, conversions, conversion rate and a "x.xx %" label per group."""
    g = df.groupBy(*by, GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(CONVERTED)).alias("conversions")
    )
    pct = round_ratio(F.col("conversions") * 100, F.col("n"), 2)
    return g.select(
        *by,
        GROUP,
        "n",
        "conversions",
        (F.col("conversions").cast("double") / F.col("n")).alias("rate"),
        F.concat(pct.cast("string"), F.lit(" %")).alias("label"),
    ).orderBy(*by, GROUP)


def arm_counts(
    df: DataFrame, by: Sequence[str] = (), control: str = CONTROL, test: str = TEST
) -> DataFrame:
    """Arm sizes and conversions, one row per experiment (one aggregate pass)."""
    g, c = F.col(GROUP), F.col(CONVERTED)
    return df.groupBy(*by).agg(
        F.count_if(g == control).alias("n_control"),
        F.count_if(g == test).alias("n_test"),
        F.count_if((g == control) & c).alias("conv_control"),
        F.count_if((g == test) & c).alias("conv_test"),
    )


def _rates(counts: DataFrame) -> DataFrame:
    """Conversion rates rounded to 4 dp (``k`` = rate in 1e-4 units)."""
    return counts.withColumns(
        {
            "k_control": round_ratio_units(F.col("conv_control"), F.col("n_control"), 4),
            "k_test": round_ratio_units(F.col("conv_test"), F.col("n_test"), 4),
        }
    ).withColumns(
        {
            "p_control": units_to_double(F.col("k_control"), 4),
            "p_test": units_to_double(F.col("k_test"), 4),
        }
    )


def _h(p_control: F.Column, p_test: F.Column) -> F.Column:
    return F.lit(2.0) * (F.asin(F.sqrt(p_control)) - F.asin(F.sqrt(p_test)))


def _magnitude(h: F.Column) -> F.Column:
    return (
        F.when(h > EFFECT_LARGE, F.lit("large"))
        .when(h > EFFECT_MEDIUM, F.lit("medium"))
        .when(h > EFFECT_SMALL, F.lit("small"))
        .otherwise(F.lit("very small"))
    )


def ab_effect_size(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's h on 4-dp rates, h = 2 asin sqrt p_control - 2 asin sqrt
    p_test (signed, control - test), |difference| in percentage points, and
    the magnitude class of the signed h (reference) and of |h|."""
    r = _rates(arm_counts(df, by))
    h = _h(F.col("p_control"), F.col("p_test"))
    return r.select(
        *by,
        "n_control",
        "n_test",
        "p_control",
        "p_test",
        units_to_double(F.abs(F.col("k_test") - F.col("k_control")), 2).alias("delta_pp"),
        h.alias("effect_size"),
        _magnitude(h).alias("magnitude_signed"),
        _magnitude(F.abs(h)).alias("magnitude"),
    )


def ab_exposure_balance(df: DataFrame, by: Sequence[str] = (), col: str = EXPOSURE) -> DataFrame:
    """Per group mean exposure and box-plot statistics (exact quartiles,
    whiskers at the most extreme values within 1.5 IQR, outlier count).

    Everything is read from value counts: equal exposures are one row there,
    however many users have them, so no group and no value is hot."""
    keys = [*by, GROUP]
    counts = value_counts(df, col, keys)
    q = quantiles_of_counts(counts, [0.25, 0.5, 0.75], ["q1", "median", "q3"], keys)
    t = attach(counts, q, keys)
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col("_x") >= lo) & (F.col("_x") <= hi)
    return (
        t.groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.col("_c"))), F.lit(0)).alias("n"),
            F.try_divide(
                F.sum(F.col("_x") * F.col("_c")), F.sum(F.when(F.col("_x").isNotNull(), F.col("_c")))
            ).alias("mean"),
            F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).alias("n_outliers"),
        )
        .select(*keys, "n", "mean", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")
        .orderBy(*keys)
    )


def _mix(df: DataFrame, dim: str, by: Sequence[str]) -> DataFrame:
    c = df.groupBy(*by, GROUP, dim).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, GROUP))
    return c.select(*by, GROUP, dim, round_ratio(F.col("n") * 100, total, 2).alias("share_pct")).orderBy(
        *by, GROUP, dim
    )


def ab_day_mix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row-normalised crosstab group x most_ads_day, % (2 dp). The
    reference computes it on the untrimmed frame."""
    return _mix(df, "most_ads_day", by)


def ab_hour_mix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Same as A8 by most_ads_hour."""
    return _mix(df, "most_ads_hour", by)


def ab_normality_check(df: DataFrame, by: Sequence[str] = (), min_count: int = 10) -> DataFrame:
    """A10: n*p and n*(1-p) above ``min_count`` in both arms (p rounded to 4
    dp, compared exactly in integers)."""
    r = _rates(arm_counts(df, by))
    lim = min_count * 10_000
    n_c, n_t = F.col("n_control"), F.col("n_test")
    k_c, k_t = F.col("k_control"), F.col("k_test")
    conds = {
        "control_successes_ok": n_c * k_c > lim,
        "control_failures_ok": n_c * (10_000 - k_c) > lim,
        "test_successes_ok": n_t * k_t > lim,
        "test_failures_ok": n_t * (10_000 - k_t) > lim,
    }
    all_ok = conds["control_successes_ok"]
    for c in list(conds.values())[1:]:
        all_ok = all_ok & c
    return r.select(*by, *[v.alias(k) for k, v in conds.items()], all_ok.alias("normal_approx_ok"))


def ab_group_sizes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per group, largest first."""
    return df.groupBy(*by, GROUP).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, F.desc("n"), GROUP)


def ab_required_n(
    df: DataFrame, by: Sequence[str] = (), alpha: float = ALPHA, power: float = POWER, ratio: float = 1.0
) -> DataFrame:
    """Per-arm sample size to detect the observed h (two-sided alpha,
    given power, arm ratio), normal approximation:
    n = (1 + 1/ratio) * ((z_{1-alpha/2} + z_power) / h)^2; no size detects
    h = 0 (NULL).
    (A t-based solver gives about one unit more at these sizes.)"""
    z_sum = z_quantile(1 - alpha / 2) + z_quantile(power)
    e = ab_effect_size(df, by)
    n = F.lit(1.0 + 1.0 / ratio) * F.pow(F.try_divide(F.lit(z_sum), F.col("effect_size")), 2)
    return e.select(
        *by,
        "effect_size",
        n.alias("required_n"),
        F.ceil(n).cast("bigint").alias("required_n_ceil"),
    )


def ab_required_n_t(
    df: DataFrame, by: Sequence[str] = (), alpha: float = ALPHA, power: float = POWER, ratio: float = 1.0
) -> DataFrame:
    """A12 as the two-sample t test solves it: the size of the first arm
    (the second has ``ratio`` times as many) that detects the observed h.
    ``required_n_rounded`` is rounded to the nearest integer (halves to even).
    NULL for h = 0 and for an empty arm; at least two a group."""
    n = t_test_size(F.col("effect_size"), alpha, power, ratio)
    sized = ab_effect_size(df, by).select(*by, "effect_size", n.alias("required_n"))
    return sized.withColumns(
        {
            "required_n_rounded": F.rint("required_n").cast("bigint"),
            "required_n_ceil": F.ceil("required_n").cast("bigint"),
        }
    )


def _size(col: str) -> F.Column:
    """An arm's size; NULL for an empty arm, and so is all that divides by it."""
    return F.nullif(F.col(col).cast("double"), F.lit(0.0))


def _z(counts: DataFrame) -> F.Column:
    n_c, n_t = _size("n_control"), _size("n_test")
    p1 = F.col("conv_control") / n_c
    p2 = F.col("conv_test") / n_t
    pooled = (F.col("conv_control") + F.col("conv_test")) / (n_c + n_t)
    var = pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n_c + F.lit(1.0) / n_t)
    return F.try_divide(p1 - p2, F.sqrt(var))


def ab_ztest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A13 (statistic): pooled two-proportion z, control - test. NULL for an
    experiment with an empty arm, or without spread (all or none converted)."""
    c = arm_counts(df, by)
    return c.select(*by, "n_control", "n_test", "conv_control", "conv_test", _z(c).alias("z"))


def ab_ztest_pvalue(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Z and its two-sided p-value (normal CDF on aggregated rows)."""
    z = ab_ztest(df, by)
    return z.select(*by, "z", two_sided_p(F.col("z")).alias("p_value"))


def ab_power(df: DataFrame, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Achieved power for the observed h with the actual arm sizes
    (normal approximation of the two-sample test):
    Phi(lambda - z) + Phi(-lambda - z), lambda = h sqrt(n1 n2 / (n1 + n2))."""
    z = z_quantile(1 - alpha / 2)
    e = ab_effect_size(df, by)
    n1, n2 = _size("n_control"), _size("n_test")
    lam = F.col("effect_size") * F.sqrt(n1 * n2 / (n1 + n2))
    pw = normal_cdf(lam - F.lit(z)) + normal_cdf(-lam - F.lit(z))
    return e.select(*by, "effect_size", pw.alias("power")).withColumn(
        "power_rounded", F.round("power").cast("int")
    )


def ab_power_t(df: DataFrame, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """A14 by the noncentral t distribution: achieved power of the two-sided
    two-sample t test for the observed h with the actual arm sizes. NULL for
    an experiment with an empty arm or fewer than four rows in all."""
    pw = t_test_power(F.col("effect_size"), _size("n_control"), _size("n_test"), alpha)
    return (
        ab_effect_size(df, by)
        .select(*by, "n_control", "n_test", "effect_size", pw.alias("power"))
        .withColumn("power_rounded", F.round("power").cast("int"))
    )


def ab_null_distribution(df: DataFrame, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Pooled rate, standard error and critical values of the
    difference under H0, rounded to 3 dp as the reference prints them and
    unrounded (``*_exact``), plus the observed difference p_test - p_control
    of the 4-dp rates. NULL for an experiment with an empty arm."""
    r = _rates(arm_counts(df, by))
    n_c, n_t = F.col("n_control"), F.col("n_test")
    pooled_num = n_c * F.col("k_control") + n_t * F.col("k_test")
    pooled_den = F.nullif((n_c + n_t) * 10_000, F.lit(0))
    p3 = round_ratio(pooled_num, pooled_den, 3)
    inv = F.lit(1.0) / _size("n_control") + F.lit(1.0) / _size("n_test")
    p_exact = pooled_num.cast("double") / pooled_den.cast("double")
    se3 = F.round(F.sqrt(p3 * (F.lit(1.0) - p3) * inv), 3)
    z_lo, z_hi = z_quantile(alpha / 2), z_quantile(1 - alpha / 2)
    se_exact = F.sqrt(p_exact * (F.lit(1.0) - p_exact) * inv)
    return r.select(
        *by,
        p3.alias("p_pooled"),
        se3.alias("se"),
        F.round(F.lit(z_lo) * se3, 3).alias("cutoff_left"),
        F.round(F.lit(z_hi) * se3, 3).alias("cutoff_right"),
        units_to_double(F.col("k_test") - F.col("k_control"), 4).alias("delta"),
        p_exact.alias("p_pooled_exact"),
        se_exact.alias("se_exact"),
        (F.lit(z_lo) * se_exact).alias("cutoff_left_exact"),
        (F.lit(z_hi) * se_exact).alias("cutoff_right_exact"),
    )


def ab_null_curve(
    df: DataFrame,
    by: Sequence[str] = (),
    alpha: float = ALPHA,
    points: int = NULL_CURVE_POINTS,
    half_width_se: float = NULL_CURVE_HALF_WIDTH_SE,
) -> DataFrame:
    """The H0 density of the difference on ``points`` evenly spaced x
    in +-half_width_se * SE, and whether x lies in a rejection tail. Uses the
    unrounded SE and cutoffs (the 3-digit ones vanish for large samples);
    an experiment without an SE, or with none, has no curve."""
    nd = ab_null_distribution(df, by, alpha).where(F.col("se_exact") > 0)
    se = F.col("se_exact")
    lo = F.lit(-half_width_se) * se
    step = F.lit(2.0 * half_width_se) * se / F.lit(float(points - 1))
    x = lo + F.col("i") * step
    u = x / se
    pdf = F.exp(F.lit(-0.5) * u * u) / (se * F.lit((2.0 * 3.141592653589793) ** 0.5))
    return (
        nd.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .select(
            *by,
            "i",
            x.alias("x"),
            pdf.alias("pdf"),
            ((x <= F.col("cutoff_left_exact")) | (x >= F.col("cutoff_right_exact"))).alias("in_rejection"),
        )
        .orderBy(*by, "i")
    )
