"""Readers for the logical inputs (S1-S6 of the inventory).

Parquet is the default: the scan gets column pruning and predicate
pushdown from Catalyst. CSV readers always take an explicit schema, since
schema inference is an extra full pass over the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER_ACTIONS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
    ]
)
COURIER_ACTIONS = T.StructType(
    [
        T.StructField("courier_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
    ]
)
ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("creation_time", T.TimestampNTZType()),
        T.StructField("product_ids", T.ArrayType(T.LongType())),
    ]
)
PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", T.DecimalType(12, 2)),
    ]
)
# Online-retail transactions (CSV header names of the source file).
RETAIL = T.StructType(
    [
        T.StructField("InvoiceNo", T.LongType()),
        T.StructField("StockCode", T.LongType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DecimalType(12, 2)),
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Country", T.StringType()),
    ]
)
# A/B experiment export: header names contain spaces in the source file.
AB_RAW = T.StructType(
    [
        T.StructField("user id", T.LongType()),
        T.StructField("test group", T.StringType()),
        T.StructField("converted", T.BooleanType()),
        T.StructField("total ads", T.IntegerType()),
        T.StructField("most ads day", T.StringType()),
        T.StructField("most ads hour", T.IntegerType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``{folder}/{name}.parquet``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    index_column: bool = False,
    timestamp_format: str | None = None,
) -> DataFrame:
    """CSV with header and an explicit schema.

    ``index_column`` declares a leading unnamed row-index column (a pandas
    export artefact); it is read and dropped (S4).
    """
    fields = list(schema.fields)
    if index_column:
        fields = [T.StructField("_index", T.LongType())] + fields
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format)
    df = reader.schema(T.StructType(fields)).csv(path)
    return df.drop("_index") if index_column else df


def snake_columns(df: DataFrame) -> DataFrame:
    """Rename columns, spaces -> underscores."""
    return df.withColumnsRenamed({c: c.replace(" ", "_") for c in df.columns if " " in c})


def to_timestamp_column(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Cast a string column to timestamp_ntz."""
    value = F.to_timestamp_ntz(F.col(column), F.lit(fmt)) if fmt else F.col(column).cast(
        "timestamp_ntz"
    )
    return df.withColumn(column, value)


def row_positions(spark: SparkSession, *paths: str, name: str = "position") -> DataFrame:
    """A Parquet table with each row's place in it, from 0, as column ``name``.

    A row's place in its file is what the Parquet reader tells
    (``_metadata.row_index``); files follow one another by path. So rows are
    numbered where they are read: only the files' sizes, a row a file, are
    added up in order.
    """
    read = spark.read.parquet(*paths)
    own = [F.col(f"`{c}`") for c in read.columns]
    rows = read.select(*own, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_file").agg((F.max("_at") + 1).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(offsets, "_file").select(*own, (F.col("_before") + F.col("_at")).alias(name))


def drop_row_at(spark: SparkSession, positions: Sequence[int], *paths: str, missing: str = "ignore") -> DataFrame:
    """A Parquet table without the rows at the given places (from 0).

    ``missing='raise'`` refuses places that the table doesn't have. The list
    is a parameter of the report.
    """
    if missing not in ("ignore", "raise"):
        raise ValueError("missing must be 'ignore' or 'raise'")
    rows = row_positions(spark, *paths, name="_position")
    if missing == "raise":
        have = rows.agg(F.coalesce(F.max("_position"), F.lit(-1))).first()[0]
        beyond = [p for p in positions if not 0 <= p <= have]
        if beyond:
            raise KeyError(f"no rows at {beyond}")
    return rows.where(~F.col("_position").isin([int(p) for p in positions])).drop("_position")
