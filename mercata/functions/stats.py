"""Normal-distribution helpers for the experiment statistics.

Spark SQL has no ``erf``/``erfc``. Both are Column arithmetic here: the
(all-positive) series of erf near zero, the continued fraction of erfc
beyond it. Quantile constants are computed once on the driver from the
standard library.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

STD_NORMAL = NormalDist()
#: Terms of the series, levels of the fraction, and where one takes over from the other.
SERIES_TERMS, FRACTION_LEVELS, SERIES_END = 80, 60, 3.0


def z_quantile(p: float) -> float:
    """Standard normal quantile (ppf)."""
    return STD_NORMAL.inv_cdf(p)


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _erfc_positive(x: Column) -> Column:
    two_xx = F.lit(2.0) * x * x
    series = F.lit(1.0)
    for n in range(SERIES_TERMS, 0, -1):
        series = F.lit(1.0) + two_xx * F.lit(1.0 / (2 * n + 1)) * series
    bell = F.exp(-x * x)
    near = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * x * bell * series
    fraction = F.lit(1.0)
    for n in range(FRACTION_LEVELS, 0, -1):
        fraction = F.lit(1.0) + F.lit(float(n)) / two_xx / fraction
    far = bell / (x * F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(x < SERIES_END, near).otherwise(far)


def erfc(x: Column) -> Column:
    """Complementary error function (NULL stays NULL)."""
    positive = _once(F.abs(x), _erfc_positive)
    return F.when(x < 0, F.lit(2.0) - positive).otherwise(positive)


def normal_cdf(x: Column) -> Column:
    """Phi(x) = erfc(-x / sqrt 2) / 2."""
    return _once(-x / F.lit(math.sqrt(2.0)), erfc) / F.lit(2.0)


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) = erfc(|z| / sqrt 2)."""
    return _once(F.abs(z) / F.lit(math.sqrt(2.0)), _erfc_positive)


# ---- Student's t -----------------------------------------------------------
#
# Both t distributions are normal probabilities averaged over S = sqrt(V / df),
# V chi-squared: P(T > c) with noncentrality d is E[Phi(d - c S)]. The average
# is a trapezoid rule in u = ln S, whose density is exp(df (u - e^(2u) / 2)) up
# to a constant: it is smooth and falls off exponentially at both ends, so the
# rule converges geometrically and T_NODES nodes give about 1e-13 from two
# degrees of freedom to any number of them, at the same cost.

#: Nodes of the average over S, Newton steps for a critical value, and steps of the search for a size.
T_NODES, NEWTON_STEPS, SIZE_STEPS = 192, 5, 24

# Hart's rational approximation of exp(x^2 / 2) Phi(-x) on 0 <= x < 7.07 (double precision).
HART_TOP = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
)
HART_BOTTOM = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
HART_END = 7.07106781186547


def _upper_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0, in some twenty operations: for averages over many nodes."""

    def tail(v: Column) -> Column:
        top, bottom = F.lit(HART_TOP[0]), F.lit(HART_BOTTOM[0])
        for c in HART_TOP[1:]:
            top = top * v + F.lit(c)
        for c in HART_BOTTOM[1:]:
            bottom = bottom * v + F.lit(c)
        fraction = v + F.lit(0.65)
        for k in (4.0, 3.0, 2.0, 1.0):
            fraction = v + F.lit(k) / fraction
        near = top / bottom
        return F.exp(F.lit(-0.5) * v * v) * F.when(v < HART_END, near).otherwise(F.lit(1 / math.sqrt(2 * math.pi)) / fraction)

    return _once(x, tail)


def _lower(x: Column) -> Column:
    """P(Z < x)."""
    return _once(x, lambda v: _once(_upper_tail(F.abs(v)), lambda t: F.when(v < 0, t).otherwise(F.lit(1.0) - t)))


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once (also for structs and arrays)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _scale_nodes(df: Column) -> Column:
    """Nodes (s, weight) of the average over S; weights add up to 1."""
    left = F.lit(40.0) / df + F.lit(9.0) / F.sqrt(df)
    step = (left + F.lit(9.0) / F.sqrt(df)) / F.lit(float(T_NODES))

    def node(i: Column) -> Column:
        u = i.cast("double") * step - left
        # expm1 keeps u - (e^2u - 1) / 2 exact near 0, where the weight of many degrees of freedom lies
        return F.struct(F.exp(u).alias("s"), F.exp(df * (u - F.expm1(F.lit(2.0) * u) / F.lit(2.0))).alias("w"))

    raw = F.transform(F.sequence(F.lit(0), F.lit(T_NODES)), node)

    def normed(nodes: Column) -> Column:
        total = F.aggregate(nodes, F.lit(0.0), lambda a, n: a + n["w"])
        return _let(total, lambda t: F.transform(nodes, lambda n: F.struct(n["s"].alias("s"), (n["w"] / t).alias("w"))))

    return _let(raw, normed)


def _t_critical(nodes: Column, alpha: float, df: Column) -> Column:
    """Two-sided critical value: the expansion in 1 / df about the normal one, then Newton's method."""
    z = z_quantile(1 - alpha / 2)
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    start = F.lit(0.0)
    for t in reversed(terms):
        start = (start + F.lit(t)) / df

    def step(c: Column, _: Column) -> Column:
        def add(a: Column, n: Column) -> Column:
            return _let(
                c * n["s"],
                lambda x: F.struct(
                    (a["tail"] + n["w"] * F.lit(2.0) * _upper_tail(x)).alias("tail"),
                    (a["slope"] + n["w"] * n["s"] * F.lit(2.0 / math.sqrt(2.0 * math.pi)) * F.exp(F.lit(-0.5) * x * x)).alias("slope"),
                ),
            )

        zero = F.struct(F.lit(0.0).alias("tail"), F.lit(0.0).alias("slope"))
        return F.aggregate(nodes, zero, add, lambda a: c + (a["tail"] - F.lit(alpha)) / a["slope"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(z) + start, step)


def t_critical(alpha: float, df: Column) -> Column:
    """Two-sided critical value of Student's t with ``df`` >= 2 degrees of freedom (NULL below)."""
    df = F.when(df >= 2, df.cast("double"))
    return _let(df, lambda d: F.when(d.isNotNull(), _let(_scale_nodes(d), lambda nodes: _t_critical(nodes, alpha, d))))


def t_test_power(effect: Column, n1: Column, n2: Column, alpha: float) -> Column:
    """Power of the two-sided two-sample t test for a standardised effect.

    The chance that a noncentral t with n1 + n2 - 2 degrees of freedom and
    noncentrality ``effect * sqrt(n1 n2 / (n1 + n2))`` lies beyond either
    critical value. NULL below two degrees of freedom or for a NULL input.
    """
    n1, n2 = n1.cast("double"), n2.cast("double")
    inputs = F.struct((n1 + n2 - 2).alias("df"), (F.abs(effect) * F.sqrt(n1 * n2 / (n1 + n2))).alias("d"))

    def power(x: Column) -> Column:
        def averaged(nodes: Column) -> Column:
            beyond = lambda c: F.aggregate(
                nodes, F.lit(0.0), lambda a, n: a + n["w"] * (_lower(x["d"] - c * n["s"]) + _lower(-x["d"] - c * n["s"]))
            )
            return _let(_t_critical(nodes, alpha, x["df"]), beyond)

        return F.when((x["df"] >= 2) & x["d"].isNotNull(), _let(_scale_nodes(x["df"]), averaged))

    return _let(inputs, power)


def t_test_size(effect: Column, alpha: float, power: float, ratio: float) -> Column:
    """Size of the first arm (the second has ``ratio`` times as many) at which the t test has the given power.

    Power grows with the size, so the size is bracketed: a t test always
    needs more than the normal theory says, and not far more. The bracket
    closes by the false position rule, the end that stays halving its weight.
    At least two in the first arm; NULL for no effect.
    """
    z = z_quantile(1 - alpha / 2)
    normal = F.lit((1.0 + 1.0 / ratio) * (z + z_quantile(power)) ** 2) / F.nullif(effect * effect, F.lit(0.0))
    least = F.greatest(normal, F.lit(2.0 * max(1.0, 2.0 / (1.0 + ratio))))
    # a and b: how far the power at lo and hi falls short; the first two steps find them
    start = F.struct(least.alias("lo"), (least + F.lit(20.0 + 4 * z * z)).alias("hi"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("kept"))

    def close(s: Column, i: Column) -> Column:
        between = s["lo"] + (s["hi"] - s["lo"]) * s["a"] / (s["a"] - s["b"])
        at = F.when(i == 0, s["lo"]).when(i == 1, s["hi"]).otherwise(between)

        def pick(m: Column) -> Column:
            up = (m["f"] > 0) & (i > 1)
            down = (m["f"] <= 0) & (i > 1)
            half = lambda v, again: F.when(again, v / F.lit(2.0)).otherwise(v)
            return F.struct(
                F.when(up, m["n"]).otherwise(s["lo"]).alias("lo"),
                F.when(down, m["n"]).otherwise(s["hi"]).alias("hi"),
                F.when(up | (i == 0), m["f"]).otherwise(half(s["a"], down & (s["kept"] == -1))).alias("a"),
                F.when(down | (i == 1), m["f"]).otherwise(half(s["b"], up & (s["kept"] == 1))).alias("b"),
                F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0)).alias("kept"),
            )

        found = _let(at, lambda n: F.struct(n.alias("n"), (F.lit(power) - t_test_power(effect, n, n * F.lit(float(ratio)), alpha)).alias("f")))
        # closed to the last bits, or the least size has the power already
        done = (i > 1) & ((s["a"] <= 0) | (s["hi"] - s["lo"] <= s["hi"] * F.lit(1e-14)) | (s["a"] - s["b"] <= F.lit(1e-15)))
        return F.when(done, s).otherwise(_let(found, pick))

    nearer = lambda s: F.when(s["a"] <= F.abs(s["b"]), s["lo"]).otherwise(s["hi"])
    return F.when(normal.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(SIZE_STEPS + 1)), start, close, nearer))
