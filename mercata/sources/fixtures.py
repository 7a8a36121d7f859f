"""Deterministic mappings from the driver tables onto the logical inputs.

The reference reads external tables (a delivery service database, an
online-retail CSV, an A/B export) that are not shipped. These mappings
derive inputs of the same shape from the TPC-H-like driver tables using
integer arithmetic only, so that an independent SQL engine can rebuild
them exactly (see ``mercata.plans.oracle``). Every mapping is a lazy plan
over the given tables, so its work grows with them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.functions.joins import parts_for
from mercata.functions.rounding import int_div
from mercata.sources import tables as _tables

# One DataFrame handle per (session, table): the driver tables are
# immutable, so the file listing and footer reads of a scan are done once
# per session, as a catalog table would (every query still scans the data).
_HANDLES: dict[tuple[str, str, str], DataFrame] = {}


def _session_key(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # sessions without a SparkContext (Spark Connect)
        return str(id(spark))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    key = (_session_key(spark), folder.rstrip("/"), name)
    df = _HANDLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _HANDLES[key] = _tables.read_table(spark, folder, name)
    return df


_LINES: dict[tuple[str, str], int] = {}


def _line_parts(spark: SparkSession, folder: str) -> int | None:
    """Partitions that the retail lines call for, by their count (from the file footers, once a session)."""
    key = (_session_key(spark), folder.rstrip("/"))
    if key not in _LINES:
        _LINES[key] = read_table(spark, folder, "lineitem").count()
    return parts_for(_LINES[key])


# Fixed values of the mappings.
START_DAY = dt.date(1995, 1, 1)  # first o_orderdate
SERVICE_START = "2022-08-24 00:00:00"  # first moment of the delivery data window
DASHBOARD_PERIOD_DAYS = 16  # 2022-08-24 .. 2022-09-08
RETENTION_PERIOD_DAYS = 60  # long enough for every lifecycle class
RETAIL_MONTHS = 80  # calendar months from the first to the last o_orderdate
ANONYMOUS_EVERY = 50  # one customer key (or user id) in so many is unknown
PRICE_OUTLIER, QUANTITY_OUTLIER = 990, 49  # above these a line is an outlier
EXPERIMENTS, ONE_ARMED = 7, 3  # parallel experiments; this one has no control
REDUCED_VAT_TYPES = ("ECONOMY", "STANDARD")
CAMPAIGN_SPEND = 250_000


@dataclass(frozen=True)
class DeliveryTables:
    user_actions: DataFrame  # user_id, order_id, action, time
    courier_actions: DataFrame  # courier_id, order_id, action, time
    orders: DataFrame  # order_id, creation_time, product_ids
    products: DataFrame  # product_id, name, price
    reduced_vat_names: DataFrame  # name


def _order_events(spark: SparkSession, folder: str, period_days: int) -> DataFrame:
    """One row per order: ids, creation time, cancellation flag, courier."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n_sup = read_table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()
    key = F.col("o_orderkey")
    day = F.pmod(
        F.datediff(F.to_date("o_orderdate"), F.lit(START_DAY)), F.lit(period_days)
    )
    base = orders.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        day.alias("di"),
        F.pmod(key, n_sup).alias("s"),
    )
    minutes = F.col("di") * 1440 + F.pmod(F.col("order_id") * 37, F.lit(1440))
    return base.select(
        "order_id",
        "user_id",
        F.timestamp_add("MINUTE", minutes, F.lit(SERVICE_START).cast("timestamp_ntz")).alias("t"),
        (F.pmod(F.col("order_id"), F.lit(20)) == 0).alias("canc"),
        F.when(F.col("di") >= F.pmod(F.col("s"), F.lit(10)), F.col("s"))
        .otherwise(F.col("s") - F.pmod(F.col("s"), F.lit(10)))
        .alias("courier_id"),
    )


def _shifted(minutes: F.Column) -> F.Column:
    return F.timestamp_add("MINUTE", minutes, F.col("t"))


def delivery_tables(
    spark: SparkSession, folder: str, period_days: int = DASHBOARD_PERIOD_DAYS
) -> DeliveryTables:
    ev = _order_events(spark, folder, period_days)

    # One scan of orders emits one or two user actions per order.
    k = F.col("k")
    user_actions = ev.select(
        "*", F.explode(F.sequence(F.lit(0), F.when(F.col("canc"), 1).otherwise(0))).alias("k")
    ).select(
        "user_id",
        "order_id",
        F.when(k == 0, F.lit("create_order")).otherwise(F.lit("cancel_order")).alias("action"),
        _shifted(k * 10).alias("time"),
    )
    courier_actions = (
        ev.where(F.pmod(F.col("order_id"), F.lit(50)) != 1)
        .select(
            "*",
            F.explode(F.sequence(F.lit(0), F.when(F.col("canc"), 0).otherwise(1))).alias("k"),
        )
        .select(
            "courier_id",
            "order_id",
            F.when(k == 0, F.lit("accept_order")).otherwise(F.lit("deliver_order")).alias("action"),
            _shifted(F.lit(15) + k * 30).alias("time"),
        )
    )
    # Basket = list of line part keys; bounded by the lines of one order.
    baskets = (
        read_table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(F.collect_list("l_partkey").alias("product_ids"))
    )
    orders = ev.select("order_id", F.col("t").alias("creation_time")).join(
        baskets, "order_id", "left"
    ).select(
        "order_id",
        "creation_time",
        F.coalesce(F.col("product_ids"), F.array().cast("array<bigint>")).alias("product_ids"),
    )
    part = read_table(spark, folder, "part")
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.concat_ws(" ", "p_brand", "p_type").alias("name"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
    )
    reduced = (
        part.where(F.col("p_type").isin(*REDUCED_VAT_TYPES))
        .select(F.concat_ws(" ", "p_brand", "p_type").alias("name"))
        .distinct()
    )
    return DeliveryTables(user_actions, courier_actions, orders, products, reduced)


def retail_transactions(spark: SparkSession, folder: str, with_duplicates: bool = True) -> DataFrame:
    """Online-retail invoice lines (InvoiceNo ... Country), all of them.

    Lines of every ``ANONYMOUS_EVERY``-th customer key have no CustomerID.

    ``with_duplicates`` appends every line of invoices with number divisible
    by 37 a second time, so de-duplication has work to do.

    Many lines are dealt by order, and by part and customer where these are
    too large to be broadcast, to as many partitions as their count calls for,
    whatever the session has, so that a task's share doesn't grow with the
    table.
    """
    li = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    c = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    c = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")
    parts = _line_parts(spark, folder)
    if parts:  # what isn't broadcast meets in the partitions of these sides
        p, c = p.repartition(parts, "p_partkey"), c.repartition(parts, "c_custkey")
    # The order comes last: the lines stay where it put them, and are de-duplicated there.
    lines = li.join(p, li.l_partkey == p.p_partkey)
    orders = o.join(c, o.o_custkey == c.c_custkey)
    if parts:
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    tx = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderkey").alias("InvoiceNo"),
            F.col("l_partkey").alias("StockCode"),
            F.col("p_name").alias("Description"),
            F.col("l_quantity").cast("int").alias("Quantity"),
            F.col("o_orderdate").alias("InvoiceDate"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("UnitPrice"),
            F.when(F.pmod("o_custkey", F.lit(ANONYMOUS_EVERY)) != 0, F.col("o_custkey")).alias("CustomerID"),
            F.col("n_name").alias("Country"),
        )
    )
    if with_duplicates:
        # One pass: lines of every 37th invoice are emitted twice.
        copies = F.when(F.pmod(F.col("InvoiceNo"), F.lit(37)) == 0, 2).otherwise(1)
        tx = tx.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    return tx


def ab_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """A/B export: one user per order (user_id, test_group, converted,
    total_ads, most_ads_day, most_ads_hour)."""
    o = read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    key = F.col("o_orderkey")
    h = F.pmod(key * 7919, F.lit(1009))
    psa = F.pmod(key, F.lit(10)) == 0
    return o.select(
        key.alias("user_id"),
        F.when(psa, F.lit("psa")).otherwise(F.lit("ad")).alias("test_group"),
        F.when(psa, h < 18).otherwise(h < 26).alias("converted"),
        (F.lit(1) + int_div(F.lit(20000), F.lit(1) + F.pmod(key * 7919, F.lit(997))))
        .cast("int")
        .alias("total_ads"),
        F.date_format("o_orderdate", "EEEE").alias("most_ads_day"),
        F.pmod(F.floor("o_totalprice"), F.lit(24)).cast("int").alias("most_ads_hour"),
    )


def campaign_tables(spark: SparkSession, user_actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(campaign_users, spend): of all users, those with id mod 10 = 0 / 1 were
    acquired by campaign_1 / campaign_2, each with the same spend, and the
    others are organic, without a spend row."""
    users = user_actions.select("user_id").distinct()
    bucket = F.pmod(F.col("user_id"), F.lit(10))
    campaign_users = users.select(
        F.when(bucket == 0, F.lit("campaign_1")).when(bucket == 1, F.lit("campaign_2")).otherwise("organic").alias("campaign"),
        "user_id",
    )
    spend = spark.createDataFrame(
        [("campaign_1", CAMPAIGN_SPEND), ("campaign_2", CAMPAIGN_SPEND)],
        "campaign string, amount bigint",
    )
    return campaign_users, spend


def ab_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """The A/B export split into parallel experiments by user; one of them
    has no control arm."""
    e = F.pmod("user_id", F.lit(EXPERIMENTS)).cast("int")
    group = F.when(e == ONE_ARMED, F.lit("ad")).otherwise(F.col("test_group"))
    return ab_experiment(spark, folder).withColumn("experiment", e).withColumn("test_group", group)


def ab_export(spark: SparkSession, folder: str) -> DataFrame:
    """The A/B export as delivered: an index column and names with spaces."""
    df = ab_experiment(spark, folder).withColumn("Unnamed: 0", F.col("user_id"))
    return df.withColumnsRenamed({c: c.replace("_", " ") for c in df.columns})


def retail_export(spark: SparkSession, folder: str) -> DataFrame:
    """The retail lines as delivered: InvoiceDate is a text."""
    text = F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")
    return retail_transactions(spark, folder).withColumn("InvoiceDate", text)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream; every ``ANONYMOUS_EVERY``-th event has no user."""
    known = F.when(F.pmod("event_id", F.lit(ANONYMOUS_EVERY)) != 0, F.col("user_id"))
    return read_table(spark, folder, "events").withColumn("user_id", known)
