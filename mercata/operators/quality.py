"""Data-quality profiling and cleaning.

Duplicate handling never gathers a duplicate group in one task: groups are
counted with map-side combine, and copies are re-emitted from the counts in
chunks spread over partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.joins import attach
from mercata.functions.lineage import materialize
from mercata.functions.quantiles import exact_quantiles

DESCRIBE_PROBS = (0.25, 0.5, 0.75)
HISTOGRAM_CHUNK = 4096
#: What a repeated digest takes in a broadcast table, its hash entry included.
DIGEST_BYTES = 64
REPLICATE_CHUNK = 10_000


def null_profile(df: DataFrame) -> DataFrame:
    """column_name, null_count for every column (one pass)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "null_count")


def _semi_or_anti(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Null-safe (``<=>``) join of ``df`` with ``keys`` on all key columns.

    Key columns are renamed first so the condition never compares a column
    with itself when ``keys`` is derived from ``df``.
    """
    cols = keys.columns
    renamed = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)])
    cond = reduce(
        lambda a, b: a & b, [df[c].eqNullSafe(renamed[f"_k{i}"]) for i, c in enumerate(cols)]
    )
    return df.join(renamed, cond, how)


def _digests(columns: Sequence[str]) -> list[F.Column]:
    """128 bits of a row as two longs; NULLs count by their place, which the plain hash skips."""
    cols = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(F.lit(seed), nulls, *cols).alias(f"_d{seed}") for seed in (1, 2)]


def _repeated_digests(df: DataFrame, digests: Sequence[F.Column]) -> DataFrame:
    """The digests that several rows have, ready to be joined.

    They are broadcast if they fit the session's threshold, by their count;
    beyond it they meet the rows in a join that exchanges both.
    """
    counted = df.select(*digests).groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    repeated = materialize(counted.select("_d1", "_d2"))
    limit = int(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("bB"))
    return F.broadcast(repeated) if repeated.count() * DIGEST_BYTES <= limit else repeated


def _suspects(df: DataFrame, digests: Sequence[F.Column] | None = None, how: str = "left_semi") -> DataFrame:
    """Rows whose digest repeats (``how`` 'left_anti': all others), whole."""
    digests = digests or _digests(df.columns)
    return df.select("*", *digests).join(_repeated_digests(df, digests), ["_d1", "_d2"], how).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def duplicate_rows(
    df: DataFrame, keep: str | bool = False, sort_by: Sequence[str] = ()
) -> DataFrame:
    """Rows that duplicate another row over all columns.

    ``keep=False`` lists every member of each duplicate group (pandas
    ``duplicated(keep=False)``); ``keep='first'`` lists the later copies only
    (n - 1 per group of n). Rows of a group are identical, so which copy is
    "first" does not matter. ``sort_by`` orders the listing (a range-
    partitioned sort, no single-task step).

    Two passes: 128-bit digests are counted first (16 bytes a row travel),
    then only rows with a repeated digest are grouped by all their columns, so
    that a digest that two different rows share lists neither.
    """
    if keep not in (False, "first"):
        raise ValueError("keep must be False or 'first'")
    return _listed(_suspects(df), keep, sort_by)


def _listed(suspects: DataFrame, keep: str | bool, sort_by: Sequence[str]) -> DataFrame:
    counts = suspects.groupBy(*[F.col(f"`{c}`") for c in suspects.columns]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    # Members of a group are identical, so its one counted row stands for all.
    out = replicate_rows(counts.withColumn("_n", F.col("_n") - (1 if keep else 0)), "_n").drop("_n")
    return out.orderBy(*sort_by) if sort_by else out


def replicate_rows(df: DataFrame, count_col: str, chunk: int = REPLICATE_CHUNK) -> DataFrame:
    """Emit each row ``count_col`` times, spreading large counts over tasks.

    A row with count n becomes ceil(n / chunk) chunk rows, which are
    redistributed round-robin before each chunk expands to its copies.
    """
    n = F.col(count_col)
    n_chunks = F.floor((n + (chunk - 1)) / chunk).cast("int")
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1))).where(n > 0)
    size = F.least(F.lit(chunk), n - F.col("_chunk") * chunk).cast("int")
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        chunks.repartition(spread)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), size)))
        .drop("_chunk", "_copy")
    )


def dedupe(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (hash aggregate with map-side combine)."""
    return df.dropDuplicates()


def dedupe_stored(df: DataFrame) -> DataFrame:
    """S10 for a wide stored table with few duplicates: digests are counted first,
    rows with one of their own pass where they were read, and only the others
    are grouped by all their columns. Reads ``df`` three times, so it should
    be a table, not a long computation; the same rows as ``dedupe``."""
    digests = _digests(df.columns)
    repeated = _repeated_digests(df, digests)
    own = [F.col(f"`{c}`") for c in df.columns]
    marked = df.select("*", *digests)
    alone = marked.join(repeated, ["_d1", "_d2"], "left_anti").select(*own)
    return alone.unionByName(marked.join(repeated, ["_d1", "_d2"], "left_semi").select(*own).dropDuplicates())


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per column.

    All columns are profiled together: one unpivot, one grouped aggregate and
    one grouped exact-quantile computation keyed by column name.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value"
    )
    stats = long.groupBy("column_name").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    qs = exact_quantiles(long, "value", DESCRIBE_PROBS, ["q25", "q50", "q75"], by=["column_name"])
    return stats.join(qs, "column_name").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def quantile(df: DataFrame, col: str, q: float, name: str = "value") -> DataFrame:
    """Exact linearly-interpolated quantile as a one-row frame."""
    return exact_quantiles(df, col, [q], [name])


def outlier_rows(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Rows with ``col > threshold`` (pushed down to the scan when possible)."""
    return df.where(F.col(col) > F.lit(threshold))


def drop_outliers(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Complement of :func:`outlier_rows` (NULLs kept): a pushed-down filter."""
    return df.where(F.col(col).isNull() | (F.col(col) <= F.lit(threshold)))


def drop_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Remove rows by business key (all columns of ``rows``); the
    positional index the reference uses has no Spark equivalent."""
    return _semi_or_anti(df, rows, "left_anti")


def histogram_frame(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """H1: equal-width histogram over [min, max] (last bin closed), all bins
    present: bin, bin_lo, bin_hi, n."""
    x = F.col(col).cast("double")
    ends = materialize(df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))).select(
        "_lo", ((F.col("_hi") - F.col("_lo")) / F.lit(float(bins))).alias("_width")
    )
    place = F.floor((F.col("_x") - F.col("_lo")) / F.nullif(F.col("_width"), F.lit(0.0)))
    idx = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))
    rows = attach(df.select(x.alias("_x")).where(F.col("_x").isNotNull()), ends, [])
    counts = rows.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Every bin is listed, empty ones with 0 (bins is a parameter).
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        attach(grid.join(counts, "bin", "left"), ends, [])
        .select(
            "bin",
            (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_lo"),
            (F.col("_lo") + (F.col("bin") + 1) * F.col("_width")).alias("bin_hi"),
            F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        )
        .orderBy("bin")
    )


def histogram_auto(df: DataFrame, col: str) -> DataFrame:
    """H1 with as many bins as the data call for: bin, bin_lo, bin_hi, n.

    The bin width is the smaller of the Sturges width, range / (log2 n + 1),
    and the Freedman-Diaconis width, 2 IQR / n^(1/3), if the exact quartiles
    differ, and at least 1 for integers. The number of bins is a value of the
    running job: it's listed bin by bin from the counts' own row, in chunks,
    so that a far outlier makes many rows and no large array. A constant
    column has one bin from half below to half above; no values, no bins.
    """
    x = F.col(col).cast("double")
    whole = df.schema[col].dataType.typeName() in ("byte", "short", "integer", "long")
    q = exact_quantiles(df, col, [0.25, 0.75], ["_q1", "_q3"])
    ends = attach(df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n")), q, []).where("_n > 0")
    reach = F.col("_hi") - F.col("_lo")
    n = F.col("_n").cast("double")
    sturges = reach / (F.log2(n) + F.lit(1.0))
    freedman = F.lit(2.0) * (F.col("_q3") - F.col("_q1")) / F.pow(n, F.lit(1.0 / 3.0))
    width = F.when(freedman > 0, F.least(freedman, sturges)).otherwise(sturges)
    width = F.greatest(width, F.lit(1.0)) if whole else width
    flat = reach == 0
    shape = materialize(
        ends.select(
            F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
            F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
            F.when(flat, F.lit(1)).otherwise(F.ceil(reach / width)).cast("bigint").alias("_bins"),
        )
    )
    place = F.floor((F.col("_x") - F.col("_lo")) * F.col("_bins") / (F.col("_hi") - F.col("_lo")))
    rows = attach(df.select(x.alias("_x")).where(F.col("_x").isNotNull()), shape, [])
    counts = rows.groupBy(F.least(place, F.col("_bins") - 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    chunks = shape.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_bins") - 1) / HISTOGRAM_CHUNK))))
    first = F.col("_chunk") * HISTOGRAM_CHUNK
    bins = chunks.withColumn("bin", F.explode(F.sequence(first, F.least(first + HISTOGRAM_CHUNK, F.col("_bins")) - 1)))
    edge = lambda b: F.col("_lo") + b * (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    return (
        bins.join(counts, "bin", "left")
        .select("bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("bin")
    )
