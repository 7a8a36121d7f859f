"""Table layout: the service's facts bucketed by order.

Cancelled orders are taken out, flagged and priced by order id in nearly every
report. Tables that are written once in buckets of that id, sorted within,
meet there without an exchange: the anti joins, flags and distinct sets of a
report read their buckets as they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercata.sources.fixtures import DeliveryTables


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as a catalog table in ``buckets`` of ``key``, sorted within, and read it back.

    Rows go to their bucket before they are written, so that there is a file
    a bucket, not one a bucket and task. ``path`` places the files; without
    it they go to the catalog's warehouse, which a cluster's machines share.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def bucket_by_order(tables: DeliveryTables, buckets: int, prefix: str = "delivery", folder: str | None = None) -> DeliveryTables:
    """The service's fact tables in equal buckets by order id.

    Choose ``buckets`` so that one bucket of all facts fits a task. Products
    have no order id and stay as they are. Rows without an order id share a
    bucket; they match nothing.
    """
    place = lambda name: f"{folder.rstrip('/')}/{prefix}_{name}" if folder else None
    facts = {
        name: write_bucketed(getattr(tables, name), f"{prefix}_{name}", "order_id", buckets, place(name))
        for name in ("user_actions", "courier_actions", "orders")
    }
    return DeliveryTables(**facts, products=tables.products, reduced_vat_names=tables.reduced_vat_names)


def open_bucketed(spark: SparkSession, tables: DeliveryTables, prefix: str = "delivery") -> DeliveryTables:
    """Tables that ``bucket_by_order`` wrote in an earlier session of the same catalog."""
    facts = {name: spark.table(f"{prefix}_{name}") for name in ("user_actions", "courier_actions", "orders")}
    return DeliveryTables(**facts, products=tables.products, reduced_vat_names=tables.reduced_vat_names)
