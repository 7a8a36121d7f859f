"""Monthly acquisition cohorts of customers.

A cohort is the calendar month of a customer's first purchase; the cohort
index of a purchase is the number of months since then, plus one. The
matrix only needs distinct (customer, month) pairs, so it is computed on
those (map-side de-duplicated) instead of on every invoice line; the
first-month lookup is a window over a customer's distinct months, which is
bounded by the number of months in the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.joins import join_per_key, parts_for
from mercata.functions.lineage import materialize
from mercata.functions.rounding import round_ratio, round_ratio_units


def _month_index(month: F.Column, cohort: F.Column) -> F.Column:
    return (F.year(month) - F.year(cohort)) * 12 + (F.month(month) - F.month(cohort)) + 1


def cohort_assign(tx: DataFrame, customer: str = "CustomerID", ts: str = "InvoiceDate") -> DataFrame:
    """Every transaction plus YearMonth, CohortMonth and CohortIndex.

    Row-preserving: lines without a customer stay, with NULL CohortMonth and
    CohortIndex. Every line meets its customer's first month in a join that
    spreads customers holding a large share of the lines, over as many
    partitions as the lines call for. The first months are written once.
    """
    per = tx.groupBy(customer).agg(F.min(F.trunc(ts, "month")).alias("CohortMonth"), F.count(F.lit(1)).alias("_rows"))
    per = materialize(per)
    parts = parts_for(per.agg(F.sum("_rows")).first()[0] or 0)
    first = per.where(F.col(customer).isNotNull())
    return join_per_key(tx.withColumn("YearMonth", F.trunc(ts, "month")), first, [customer], parts=parts).withColumn(
        "CohortIndex", _month_index(F.col(ts), F.col("CohortMonth")).cast("int")
    )


def customer_months(tx: DataFrame, customer: str = "CustomerID", ts: str = "InvoiceDate") -> DataFrame:
    """Distinct (customer, YearMonth) with CohortMonth and CohortIndex; lines
    without a customer belong to no cohort."""
    months = tx.where(F.col(customer).isNotNull()).select(customer, F.trunc(ts, "month").alias("YearMonth")).distinct()
    cohort = F.min("YearMonth").over(Window.partitionBy(customer))
    return months.withColumn("CohortMonth", cohort).withColumn(
        "CohortIndex", _month_index(F.col("YearMonth"), F.col("CohortMonth")).cast("int")
    )


def cohort_matrix(tx: DataFrame, customer: str = "CustomerID", ts: str = "InvoiceDate") -> DataFrame:
    """C2 (long form): CohortMonth, CohortIndex, n_customers (distinct)."""
    return (
        customer_months(tx, customer, ts)
        .groupBy("CohortMonth", "CohortIndex")
        .agg(F.count(customer).alias("n_customers"))
        .orderBy("CohortMonth", "CohortIndex")
    )


def pivot_wide(
    long: DataFrame, row: Sequence[str], column: str, value: str, values: Sequence, prefix: str = "m"
) -> DataFrame:
    """Long cells as one row per ``row`` and one column per listed value; a
    missing cell is NULL. The values are a parameter of the report, so no job
    looks for them; a cell outside them raises instead of being dropped."""
    kind = long.schema[value].dataType
    cells = [F.max(F.when(F.col(column) == v, F.col(value))).cast(kind).alias(f"{prefix}{v}") for v in values]
    # counted with the cells, in the same pass
    wide = long.groupBy(*row).agg(*cells, F.count_if(~F.col(column).isin(*values)).alias("_outside"))
    guard = F.when(F.col("_outside") > 0, F.raise_error(F.lit(f"{column} outside the listed values")))
    first, *rest = [f"{prefix}{v}" for v in values]
    return wide.select(*row, F.coalesce(guard.cast(kind), F.col(f"`{first}`")).alias(first), *[F.col(f"`{c}`") for c in rest])


def cohort_matrix_wide(
    tx: DataFrame, indices: Sequence[int], customer: str = "CustomerID", ts: str = "InvoiceDate"
) -> DataFrame:
    """C2 (wide form): one row per cohort, one column per index of ``indices``."""
    return pivot_wide(
        cohort_matrix(tx, customer, ts), ["CohortMonth"], "CohortIndex", "n_customers", [int(i) for i in indices]
    ).orderBy("CohortMonth")


def cohort_reconcile(tx: DataFrame, customer: str = "CustomerID", ts: str = "InvoiceDate") -> DataFrame:
    """The first matrix column sums to the number of distinct customers."""
    first_col = cohort_matrix(tx, customer, ts).where(F.col("CohortIndex") == 1).agg(
        F.sum("n_customers").alias("first_column_total")
    )
    distinct = tx.agg(F.count_distinct(customer)).scalar()
    return first_col.select(
        "first_column_total",
        distinct.alias("distinct_customers"),
        (F.col("first_column_total") == distinct).alias("reconciled"),
    )


def _with_first_cell(matrix: DataFrame) -> DataFrame:
    first = F.max(F.when(F.col("CohortIndex") == 1, F.col("n_customers"))).over(
        Window.partitionBy("CohortMonth")
    )
    return matrix.withColumn("_first", first)


def cohort_retention_rate(tx: DataFrame, customer: str = "CustomerID", ts: str = "InvoiceDate") -> DataFrame:
    """C4: cell / first cell of its row x 100, 2 dp (long form)."""
    m = _with_first_cell(cohort_matrix(tx, customer, ts))
    return m.select(
        "CohortMonth",
        "CohortIndex",
        round_ratio(F.col("n_customers") * 100, F.col("_first"), 2).alias("retention"),
    ).orderBy("CohortMonth", "CohortIndex")


def cohort_retention_wide(
    tx: DataFrame, indices: Sequence[int], customer: str = "CustomerID", ts: str = "InvoiceDate"
) -> DataFrame:
    """C4 (wide form): retention in % per cohort row and index column."""
    long = cohort_retention_rate(tx, customer, ts)
    return pivot_wide(long, ["CohortMonth"], "CohortIndex", "retention", [int(i) for i in indices]).orderBy("CohortMonth")


def cohort_heatmap_frame(
    tx: DataFrame, vmax: float = 0.5, customer: str = "CustomerID", ts: str = "InvoiceDate"
) -> DataFrame:
    """Chart data of C4: row label ``YYYY-MM``, fraction, fraction clipped
    to the colour scale [0, vmax], and a one-decimal percent label."""
    m = _with_first_cell(cohort_matrix(tx, customer, ts))
    rate = F.col("n_customers").cast("double") / F.col("_first").cast("double")
    permille = round_ratio_units(F.col("n_customers") * 1000, F.col("_first"), 0)
    label = F.format_string(
        "%d.%d%%", (permille / 10).cast("bigint"), F.pmod(permille, F.lit(10)).cast("bigint")
    )
    return m.select(
        F.date_format("CohortMonth", "yyyy-MM").alias("cohort_label"),
        "CohortIndex",
        rate.alias("rate"),
        F.least(F.greatest(rate, F.lit(0.0)), F.lit(float(vmax))).alias("rate_clipped"),
        label.alias("label"),
    ).orderBy("cohort_label", "CohortIndex")


def tx_time_span(tx: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """Earliest and latest transaction timestamp."""
    return tx.agg(F.min(ts).alias("earliest"), F.max(ts).alias("latest"))
