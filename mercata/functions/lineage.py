"""Cutting lineage of a frame that several branches of a plan reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mercata.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the session's checkpoint folder.

    Runs the plan once, writes the result to the shared checkpoint folder
    (``spark.checkpoint.dir``) and returns a frame that reads it back. Use it
    for a small derived frame (e.g. one row per customer) that a report
    references several times: later branches neither recompute it from the
    raw rows nor carry its lineage, and a lost executor re-reads the files
    instead of re-running the aggregation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
