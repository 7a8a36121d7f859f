"""Exact, linearly interpolated quantiles by distributed radix selection.

Spark's exact ``percentile`` merges a value->count map of the whole column
on one reducer; on a high-cardinality column at cluster scale that is one
task holding everything. The method here is exact (same answer as
``percentile`` / pandas ``quantile`` / DuckDB ``quantile_cont``) and gathers
no group anywhere:

1. Values are counted by (group, value) with map-side combine, so repeated
   values collapse to one row however hot they are. The counts are written
   once.
2. Each order statistic a probability needs is a target rank. Values are
   selected by the 64-bit pattern of the double, which orders like the value:
   12 bits a level, a count per digit finds the digit that holds the rank, and
   the next level goes on inside it. What meets in one row is a target's 4096
   counts. Digits follow the exponent first, so that far outliers cost no
   resolution: after six levels a digit is a single value.
3. Once no target has more than ``FEW`` distinct values left (at the start, if
   no group has more), a window over those picks the value at the rank; two
   neighbouring ranks are interpolated as ``lo + (hi - lo) * frac``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.joins import attach
from mercata.functions.lineage import materialize

#: Distinct values of a target that a window may sort.
FEW = 4096
#: Lowest bit of each level's digit: 12 bits of exponent and sign, then the mantissa.
SHIFTS = (52, 40, 28, 16, 4, 0)


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, _x, _c): how often each value (as a double) occurs; NULL and NaN are NULL."""
    x = F.col(column).cast("double")
    return (
        df.select(*by, F.when(~F.isnan(x), x).alias("_x"))
        .groupBy(*by, "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def ordered_bits(x: Column) -> Column:
    """A long that orders like the double: its bit pattern, negated for negative values.

    Exponent and mantissa come from scalings by powers of two, which are exact.
    """
    two = lambda k: F.pow(F.lit(2.0), k)
    size = F.abs(x)
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)).cast("int")
    low = F.when(two(guess) > size, guess - 1).when(two(guess + 1) <= size, guess + 1).otherwise(guess)
    exponent = F.least(F.greatest(low, F.lit(-1022)), F.lit(1023))

    def pattern(e: Column) -> Column:
        up = F.lit(52) - e  # in two steps, as 2 ** 1074 is no double
        half = F.floor(up / F.lit(2)).cast("int")
        return (size * two(half) * two(up - half)).cast("bigint") + (e + 1022).cast("bigint") * F.lit(1 << 52)

    bits = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(0x7FF << 52)).otherwise(
        F.get(F.transform(F.array(exponent), pattern), F.lit(0))
    )
    return F.when(x < 0, -bits).otherwise(bits)


def _in_play(counts: DataFrame, state: DataFrame, by: Sequence[str], shift: int | None) -> DataFrame:
    """Values that share the digits found so far (down to bit ``shift``) with some target, a row each."""
    rows = attach(counts, state, by).select(*by, "_x", "_bits", "_c", F.explode("_targets").alias("_t"))
    return rows if shift is None else rows.where(F.shiftright("_bits", shift) == F.col("_t.prefix"))


def _refine(counts: DataFrame, state: DataFrame, by: Sequence[str], shift: int, above: int | None) -> DataFrame:
    """One level: each target's prefix gets the digit at bit ``shift`` that holds its rank."""
    digits = (
        _in_play(counts, state, by, above)
        .groupBy(*by, "_t", F.shiftright("_bits", shift).alias("prefix"))
        .agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("left"))
    )
    per_target = digits.groupBy(*by, "_t").agg(F.sort_array(F.collect_list(F.struct("prefix", "c", "left"))).alias("digits"))
    none = F.lit(None).cast("bigint")
    zero = F.struct(F.col("_t.below").alias("below"), none.alias("prefix"), none.alias("left"))

    def walk(s: Column, d: Column) -> Column:
        ends_before = s["below"] + d["c"] <= F.col("_t.rank")
        return (
            F.when(s["prefix"].isNotNull(), s)
            .when(ends_before, F.struct((s["below"] + d["c"]).alias("below"), s["prefix"].alias("prefix"), s["left"].alias("left")))
            .otherwise(F.struct(s["below"].alias("below"), d["prefix"].alias("prefix"), d["left"].alias("left")))
        )

    found = per_target.withColumn("_f", F.aggregate("digits", zero, walk))
    target = F.struct(F.col("_t.i").alias("i"), F.col("_t.rank").alias("rank"), "_f.below", "_f.prefix", "_f.left")
    return found.groupBy(*by).agg(F.collect_list(target).alias("_targets"))


def _sizes(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _n, _distinct): values of each group, and distinct ones."""
    n = F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.col("_c"))), F.lit(0))
    return counts.groupBy(*by).agg(n.alias("_n"), F.count("_x").alias("_distinct"))


def candidates(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, _t, _x, _c): the values left to each target rank ``_t.i``, at most ``FEW`` of them.

    Ranks 2 j and 2 j + 1 are the neighbours of probability j; ``_t.below``
    counts the values below those left.
    """
    by = list(by)
    known = counts.where(F.col("_x").isNotNull())
    if "_bits" not in counts.columns:
        known = known.withColumn("_bits", ordered_bits(F.col("_x")))
    ranks = []
    for p in probs:
        k0 = F.floor((F.col("_n") - 1).cast("double") * F.lit(float(p)))
        ranks += [k0, F.least(k0 + 1, F.col("_n") - 1)]
    start = F.lit(0).cast("bigint")
    targets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), r.cast("bigint").alias("rank"), start.alias("below"), start.alias("prefix"), F.col("_distinct").alias("left")
            )
            for i, r in enumerate(ranks)
        ]
    )
    stats = _sizes(counts, by)
    state = stats.where(F.col("_n") > 0).select(*by, targets.alias("_targets"))
    most = stats.agg(F.max("_distinct")).first()[0] or 0
    shift = None
    for level in SHIFTS:
        if most <= FEW:
            break
        # a target's state is a few numbers, and the next level starts from it
        state = materialize(_refine(known, state, by, level, shift))
        shift = level
        most = state.agg(F.max(F.array_max("_targets.left"))).first()[0]
    return _in_play(known, state, by, shift).select(*by, "_t", "_x", "_c")


def quantiles_of_counts(
    counts: DataFrame, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles of (by, _x, _c) value counts: one row per group."""
    by = list(by)
    counts = materialize(counts.withColumn("_bits", F.when(F.col("_x").isNotNull(), ordered_bits(F.col("_x")))))
    upto = Window.partitionBy(*by, "_t.i").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = candidates(counts, probs, by)
    reached = left.withColumn("_cum", F.col("_t.below") + F.sum("_c").over(upto)).where(F.col("_cum") > F.col("_t.rank"))
    picked = reached.groupBy(*by).agg(
        *[F.min(F.when(F.col("_t.i") == i, F.col("_x"))).alias(f"_v{i}") for i in range(2 * len(probs))]
    )

    def value(j: int) -> Column:
        a, b = F.col(f"_v{2 * j}"), F.col(f"_v{2 * j + 1}")
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(probs[j]))
        return F.when(F.col("_n") > 0, a + (b - a) * (pos - F.floor(pos))).cast("double")

    stats = _sizes(counts, by)
    joined = stats.join(picked, by, "left") if by else attach(stats, picked, [])
    out = joined.select(*by, *[value(j).alias(nm) for j, nm in enumerate(names)])
    # One row a group, which reports refer to several times: written once.
    return materialize(out)


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group of ``by`` with one double column per probability.

    NULL and NaN values are ignored (as pandas does). A group with no values
    yields NULL quantiles.
    """
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q_{str(p).replace('.', '_')}" for p in probs]
    if len(names) != len(probs):
        raise ValueError("names and probs differ in length")
    return quantiles_of_counts(value_counts(df, column, by), probs, names, by)


def quantile_bins(value: Column, edges: Sequence[Column]) -> Column:
    """1-based bin of ``value`` for right-closed bins ``(e0, e1], (e1, e2] ...``.

    The lowest edge is included in the first bin (pandas ``qcut``); a NULL
    value has no bin.
    """
    last = len(edges) - 1
    expr = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:-1], start=1):
        expr = expr.when(value <= edge, F.lit(i))
    return expr.otherwise(F.lit(last))
