"""Join idioms the reports share.

The reference writes membership tests as ``x [NOT] IN (subquery)``, also
inside aggregate FILTER clauses. Spark plans the latter as a
BroadcastNestedLoopJoin (O(n*m)) and the former as a null-aware anti join
that must fit in memory. Here both become equi-joins against a
de-duplicated, null-free key set, which Catalyst can plan as a sort-merge,
shuffle-hash or (when the size check allows) broadcast join.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows with a NULL key match nothing; they are dealt to so many places.
NULL_PARTS = 64


def action_orders(actions: DataFrame, action: str, key: str = "order_id") -> DataFrame:
    """Distinct, null-free keys of rows with the given action."""
    return (
        actions.where((F.col("action") == F.lit(action)) & F.col(key).isNotNull())
        .select(key)
        .distinct()
    )


def _set_is_empty(keys: DataFrame) -> F.Column:
    """Scalar subquery: TRUE when ``keys`` has no rows (evaluated once per query)."""
    return keys.limit(1).select((F.count(F.lit(1)) == 0).alias("_empty")).scalar()


def _left_flag(df: DataFrame, key: str, marked: DataFrame) -> DataFrame:
    """Left join on one key that deals rows with a NULL key round."""
    null_salt = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(NULL_PARTS)) + 1)
    return (
        df.withColumn("_salt", F.coalesce(null_salt, F.lit(0)))
        .join(marked.withColumn("_salt", F.lit(0).cast("bigint")), on=[key, "_salt"], how="left")
        .drop("_salt")
    )


def not_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key NOT IN (keys)``, with SQL NULL semantics.

    A NULL key survives only when the key set is empty. ``keys`` must be
    null-free and distinct (see :func:`action_orders`). The emptiness test
    is a scalar subquery, so the plan stays one equi anti join.
    """
    kept = df.join(keys, on=key, how="left_anti")
    return kept.where(F.col(key).isNotNull() | _set_is_empty(keys))


def with_flag(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """Add boolean ``flag``: ``key IN (keys)`` (FALSE for a NULL key).

    ``keys`` must be distinct so the left join cannot multiply rows.
    """
    marked = keys.select(key).withColumn(flag, F.lit(True))
    return _left_flag(df, key, marked).withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def mark_not_in(df: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    """Add boolean ``out`` = ``key NOT IN (keys)`` with SQL NULL semantics.

    Used where the reference filters an aggregate with ``FILTER (WHERE key
    NOT IN (...))``: every row is kept, only the flag differs. A NULL key
    gives TRUE only for an empty key set (NULL, i.e. not counted, otherwise).
    """
    marked = keys.select(key).withColumn("_hit", F.lit(True))
    return (
        _left_flag(df, key, marked)
        .withColumn(
            out,
            F.when(F.col(key).isNull(), _set_is_empty(keys)).otherwise(F.col("_hit").isNull()),
        )
        .drop("_hit")
    )


#: A key is hot if it holds this part of all rows; at most so many keys can be.
HOT_PARTS = 256


def attach(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of a one-row-per-group frame to every row of ``df``.

    An equi-join on the group keys, broadcast where the planner's size check
    allows; a scalar subquery (evaluated once) when there are no groups.
    """
    if by:
        return df.join(per_group, list(by))
    row = per_group.select(F.struct(*per_group.columns).alias("_s")).scalar()
    return df.withColumn("_row", row).select("*", "_row.*").drop("_row")


def join_per_key(
    big: DataFrame, per_key: DataFrame, on: Sequence[str], rows: str = "_rows", how: str = "left", parts: int | None = None
) -> DataFrame:
    """Equi-join a large side with a side that has one row per key.

    ``per_key`` tells in ``rows`` how many rows of ``big`` each key has (the
    column is dropped). A key with 1 / HOT_PARTS of all rows or more is hot:
    there are at most HOT_PARTS of them, so they are broadcast, their rows are
    dealt round to several tasks (equal rows too), and only their one row is
    replicated. All other keys join as they are. Rows with a NULL key match
    nothing and are dealt round as well (``how`` 'left' keeps them). ``parts``:
    partitions of the join, if not the session's.
    """
    on = list(on)
    total = per_key.agg(F.sum(rows)).scalar()
    share = F.ceil(F.col(rows) * F.lit(HOT_PARTS) / total).cast("int")
    sized = per_key.withColumn("_parts", F.when(F.col(rows) * HOT_PARTS >= total, share).otherwise(F.lit(1)))
    hot = sized.where(F.col("_parts") > 1).select(*on, F.col("_parts").alias("_hot"))
    missing = reduce(operator.or_, [F.col(c).isNull() for c in on])
    spread = F.when(missing, F.lit(HOT_PARTS)).otherwise(F.coalesce(F.col("_hot"), F.lit(1)))
    salted = big.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.pmod(F.monotonically_increasing_id(), spread).cast("int")
    )
    keys = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    salted, keys = salted.drop("_hot"), keys.drop("_parts", rows)
    if parts:
        salted, keys = (side.repartition(parts, *on, "_salt") for side in (salted, keys))
    return salted.join(keys, [*on, "_salt"], how).drop("_salt")


#: Rows in a partition, and up to how many of these the session's own partitions do.
PART_ROWS, FEW_PARTS = 250_000, 8


def parts_for(rows: int) -> int | None:
    """Partitions that so many rows call for, so that a task's share doesn't grow with the table; None: the session's."""
    parts = -(-rows // PART_ROWS)
    return parts if parts > FEW_PARTS else None
