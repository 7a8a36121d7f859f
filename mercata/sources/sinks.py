"""Report sinks (S17): every report is a DataFrame, written as parquet.

``write_report`` is a plain write. ``publish_report`` replaces a report that
others read: the new files are complete before anything points to them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folder of the numbered manifests of a published report; the last one counts.
MANIFESTS = "_manifests"


def write_report(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Write a report; day-level reports are partitioned by their date so a
    dashboard reading one period prunes the other partitions."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _names(fs, folder) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the manifest that counts (0 and None without one)."""
    fs, file = _file_system(spark, path)
    numbered = [n for n in _names(fs, file(f"{path}/{MANIFESTS}")) if n.endswith(".json") and not n.startswith(".")]
    if not numbered:
        return 0, None
    stream = fs.open(file(f"{path}/{MANIFESTS}/{numbered[-1]}"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(numbered[-1].split(".")[0]), json.loads(text)


def stage_report(df: DataFrame, path: str, partition_by: str | None = None) -> dict:
    """Write a report's files below ``path`` without making them the report.

    Returns what ``switch_report`` needs. Each attempt writes a folder of its
    own, so that one that was cut off leaves nothing a reader sees.
    """
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    write_report(df, f"{path}/{version}", partition_by, mode="errorifexists")
    fs, file = _file_system(spark, path)
    parts = [n for n in _names(fs, file(f"{path}/{version}")) if "=" in n] if partition_by else [""]
    return {"parts": dict.fromkeys(parts, version), "partition_by": partition_by, "schema": df.schema.jsonValue()}


def switch_report(spark: SparkSession, path: str, staged: dict, only_parts: bool = False) -> int:
    """Make a staged write the report, by one rename; returns the manifest's number.

    ``only_parts``: the partitions that were written replace their
    predecessors and all others stay. Of two writers that started from the
    same manifest the second one fails, and nothing of the first is lost.
    """
    number, now = _manifest(spark, path)
    if only_parts and now:
        if now["partition_by"] != staged["partition_by"] or now["schema"] != staged["schema"]:
            raise ValueError("the report has other columns or partitions; replace it as a whole")
        staged = {**staged, "parts": {**now["parts"], **staged["parts"]}}
    fs, file = _file_system(spark, path)
    draft, final = file(f"{path}/{MANIFESTS}/.draft-{uuid.uuid4().hex}"), file(f"{path}/{MANIFESTS}/{number + 1:010d}.json")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(staged).encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has published {path} meanwhile")
    return number + 1


def publish_report(df: DataFrame, path: str, partition_by: str | None = None, only_parts: bool = False) -> int:
    """Replace a report, or with ``only_parts`` the partitions that ``df`` has (a day's re-run).

    Readers see the old report until the new one is complete, then the new
    one; a job that fails before the switch changes nothing.
    """
    if only_parts and not partition_by:
        raise ValueError("only_parts needs partition_by")
    return switch_report(df.sparkSession, path, stage_report(df, path, partition_by), only_parts)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The published report: the partitions that its last manifest names."""
    _, now = _manifest(spark, path)
    if now is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    schema = StructType.fromJson(now["schema"])
    versions: dict[str, list[str]] = {}
    for part, version in sorted(now["parts"].items()):
        versions.setdefault(version, []).append(part)
    out = None
    for version, parts in sorted(versions.items()):
        base = f"{path}/{version}"
        read = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{p}" if p else base for p in parts])
        read = read.select([f"`{c}`" for c in schema.names])
        out = read if out is None else out.unionByName(read)
    return out if out is not None else spark.createDataFrame([], schema)


def expire_versions(spark: SparkSession, path: str) -> list[str]:
    """Delete the versions that the last manifest doesn't name (older ones and cut-off writes); returns their names.

    Not while a report is being staged or an older one read.
    """
    _, now = _manifest(spark, path)
    fs, file = _file_system(spark, path)
    used = set(now["parts"].values()) if now else set()
    gone = [n for n in _names(fs, file(path)) if n.startswith("version-") and n not in used]
    for name in gone:
        fs.delete(file(f"{path}/{name}"), True)
    return gone
