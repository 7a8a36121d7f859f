"""Helpers that several operators share: shared tables, hot groups, whole groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder.

    Every executor reaches it, so what is written there outlives the executor
    that wrote it. Spark's file system removes it when the application ends.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/mercata-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, at a fraction of its size on disk; a
    lost executor's reader re-reads the files.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_hot_groups(
    keyed: DataFrame, keys: Sequence[str], member: str, limit: int
) -> DataFrame:
    """Give every row the block pairs in which its group is compared.

    A group of at most ``limit`` rows is one block, compared with itself. A
    larger one is cut into blocks by a hash of ``member``, and every pair of
    blocks (a block with itself too) becomes a group of its own, so that no
    task holds more than about two blocks and every pair of rows of the group
    still meets exactly once. Adds ``block`` (the row's own), ``block_a`` and
    ``block_b``.

    Group sizes come from a count with map-side combine. The table of large
    groups has at most rows / limit rows and is joined by whatever plan its
    size allows; AQE splits the skewed side of a sort-merge join.
    """
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    parts = sizes.select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_parts"))
    placed = keyed.join(parts, list(keys), "left").withColumn(
        "block",
        F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(F.col(member), F.lit("block")), F.col("_parts")).cast("int")
        ),
    )
    others = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("_parts") - 1)
    )
    return (
        placed.withColumn("_other", F.explode(others))
        .withColumn("block_a", F.least("block", "_other"))
        .withColumn("block_b", F.greatest("block", "_other"))
        .drop("_other", "_parts")
    )


def changes(*columns: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal rows in sorted columns."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 20_000
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer ``keys``, tables of whole groups.

    Yields (table, group starts) with about ``rows`` rows each: what is held
    at once is that many rows and the group that is still open.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(last: bool) -> tuple[pa.Table | None, np.ndarray, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(held).combine_chunks()
        starts = changes(*(t.column(k).to_numpy() for k in keys))
        if last:
            return t, starts, []
        end = int(starts[-1])
        rest = t.slice(end).to_batches()
        return (t.slice(0, end), starts[:-1], rest) if end else (None, starts, rest)

    wait = rows
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        n += b.num_rows
        if n >= wait:
            t, starts, held = cut(False)
            n = sum(x.num_rows for x in held)
            wait = max(rows, 2 * n)
            if t is not None:
                yield t, starts
    if held:
        t, starts, held = cut(True)
        yield t, starts


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per node 0..n-1 the smallest node that the links (a, b) reach."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
