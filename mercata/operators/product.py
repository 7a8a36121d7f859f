"""Product engagement metrics over an event stream.

The reference only names these metrics (DAU/WAU/MAU, views, CTR, audience
slices); the definitions here are the standard ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.rounding import round_ratio

ACTIVE_WINDOWS = (("dau", 1), ("wau", 7), ("mau", 30))


def dau_wau_mau(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    windows: Sequence[tuple[str, int]] = ACTIVE_WINDOWS,
) -> DataFrame:
    """Distinct active users per day over trailing windows of 1 / 7 / 30
    days, for every day that has events of known users (NULL is no user).

    Spark has no distinct-count window function. Each distinct (user, day)
    instead covers the following days up to the user's next active day (and
    at most the widest window): a per-user ``lead`` over de-duplicated days,
    so a user's partition is bounded by the number of days, not by events.
    Each (user, covered day) then exists once, carrying the days since the
    user was last active, and one conditional count per window finishes it
    with map-side combine.
    """
    longest = max(w for _, w in windows)
    user_days = events.where(F.col(user).isNotNull()).select(user, F.to_date(ts).alias("day")).distinct()
    nxt = F.lead("day").over(Window.partitionBy(user).orderBy("day"))
    span = F.least(F.coalesce(F.datediff(nxt, F.col("day")), F.lit(longest)), F.lit(longest))
    covered = user_days.withColumn("_span", span).select(
        F.explode(F.sequence(F.lit(0), F.col("_span") - 1)).alias("since"), "day"
    ).select(F.date_add("day", F.col("since")).alias("day"), "since")
    # A day has events of its own if some user was active on it.
    counts = covered.groupBy("day").agg(
        *[F.count_if(F.col("since") < w).alias(name) for name, w in windows], F.min("since").alias("_own")
    )
    return counts.where(F.col("_own") == 0).drop("_own").orderBy("day")


def engagement_ctr(
    events: DataFrame,
    ts: str = "ts",
    kind: str = "event_type",
    view: str = "view",
    click: str = "click",
) -> DataFrame:
    """Views, clicks and click-through rate (clicks / views, 4 dp) per day."""
    daily = events.groupBy(F.to_date(ts).alias("day")).agg(
        F.count_if(F.col(kind) == view).alias("views"),
        F.count_if(F.col(kind) == click).alias("clicks"),
    )
    return daily.select(
        "day", "views", "clicks", round_ratio(F.col("clicks"), F.col("views"), 4).alias("ctr")
    ).orderBy("day")


def audience_slices(users: DataFrame, dims: Sequence[str], user: str = "user_id") -> DataFrame:
    """Distinct users per value of each dimension (one grouping set per
    dimension), as (dimension, value, users)."""
    long = users.select(user, *[F.col(d).cast("string").alias(d) for d in dims]).unpivot(
        [user], list(dims), "dimension", "value"
    )
    return (
        long.groupBy("dimension", "value")
        .agg(F.count_distinct(user).alias("users"))
        .orderBy("dimension", F.desc("users"), "value")
    )


def event_users_with_profile(events: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Active users of the event stream with segment / nation / region; users
    without a customer row stay, with NULL attributes."""
    users = events.where(F.col("user_id").isNotNull()).select("user_id").distinct()
    c = customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey")
    n = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (
        users.join(c, "user_id", "left")
        .join(n, "c_nationkey", "left")
        .join(r, "n_regionkey", "left")
        .select(
            "user_id",
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
        )
    )


def user_bitmaps(rows: DataFrame, keys: Sequence[str], user: str = "user_id") -> DataFrame:
    """(keys, bucket, users): the users of each group as bitmaps of 32,768 ids.

    Bitmaps merge exactly, by OR, where distinct counts don't: coarser groups
    come from finer ones without reading the rows again. One aggregate with
    map-side combine; a group holds as many bitmaps as its users' ids fall
    into buckets, however many rows it has. Meant for dense ids such as
    surrogate keys: a bitmap is 4 KB, also for a single user. Rows without a
    user are left out.
    """
    known = rows.where(F.col(user).isNotNull()).select(*keys, F.col(user).cast("bigint").alias("_user"))
    return known.groupBy(*keys, F.bitmap_bucket_number("_user").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_user")).alias("users")
    )


def merged_users(bitmaps: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """(keys, level, users): distinct users of every grouping set, from bitmaps.

    ``level`` has a bit per key, the first key's highest, that is 1 where the
    set doesn't group by it; the key is NULL there.
    """
    columns = [F.col(k) for k in keys]
    per_bucket = bitmaps.groupingSets([[F.col(k) for k in s] + [F.col("bucket")] for s in sets], *columns, F.col("bucket")).agg(
        F.grouping_id().alias("_level"), F.bitmap_count(F.bitmap_or_agg("users")).alias("_n")
    )
    # the bucket's own bit of the level is always 0
    return per_bucket.groupBy(*keys, F.shiftright("_level", 1).cast("int").alias("level")).agg(F.sum("_n").alias("users"))


def audience_cube(
    events: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame, dims: Sequence[str] = ("segment", "nation", "region")
) -> DataFrame:
    """D8 over all combinations: distinct active users for every subset of the
    dimensions, down to the grand total. The events are read once."""
    users = event_users_with_profile(events, customer, nation, region)
    sets = [[d for i, d in enumerate(dims) if not level >> (len(dims) - 1 - i) & 1] for level in range(2 ** len(dims))]
    return merged_users(user_bitmaps(users, dims), sets, dims)


def active_users_rollup(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """D6 by calendar: distinct users of every day, ISO week, month and of all
    time, from daily bitmaps. ``period`` names the kind, ``start`` its first
    day (NULL for all time). The events are read once."""
    daily = user_bitmaps(events.withColumn("day", F.to_date(ts)), ["day"], user).withColumns(
        {"week": F.trunc("day", "week"), "month": F.trunc("day", "month")}
    )
    counted = merged_users(daily, [["day"], ["week"], ["month"], []], ["month", "week", "day"])
    period = F.when(F.col("level") == 6, "day").when(F.col("level") == 5, "week").when(F.col("level") == 3, "month").otherwise("all")
    return counted.select(period.alias("period"), F.coalesce("day", "week", "month").alias("start"), "users").orderBy("period", "start")
