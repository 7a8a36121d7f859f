"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id), so that equal texts are
neighbours. Splitters between shards are found by counting exact bytes below
candidate keys: each round counts the bytes between all probes in one pass
over the keys and narrows each splitter's range, until it is within tolerance
of its target. Then the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.common import shared_table

#: The key is 128 bits, (hash of the text, id), as two unsigned halves.
_TOP = 1 << 128
_SIGN = np.uint64(1 << 63)


def _below(probes: list[int], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per row the number of probes at or below its key."""
    top = np.array([p >> 64 for p in probes], dtype=np.uint64)
    rest = np.array([p & (2**64 - 1) for p in probes], dtype=np.uint64)
    high, low = high.view(np.uint64) ^ _SIGN, low.view(np.uint64) ^ _SIGN
    first = np.searchsorted(top, high, side="left")
    last = np.searchsorted(top, high, side="right")
    out = first.copy()
    shared = last > first
    for f in np.unique(first[shared]).tolist():
        own = np.flatnonzero(shared & (first == f))
        out[own] += np.searchsorted(rest[f : last[own[0]]], low[own], side="right")
    return out


def _histogram(probes: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = _below(probes, b.column(0).to_numpy(), b.column(1).to_numpy())
            np.add.at(size, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        held = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(held), pa.array(size[held]), pa.array(rows[held])], names=["bin", "bytes", "rows"])

    return run


def _inside(points: list[int], bins: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.isin(_below(points, b.column(0).to_numpy(), b.column(1).to_numpy()), bins)
            yield pa.record_batch([c.filter(pa.array(own)) for c in b.columns[:2]], names=["high", "low"])

    return run


def _keys_within(keys: DataFrame, ranges: list[tuple[int, int]]) -> set[int]:
    """The keys that lie in some of the ranges [low, high)."""
    if not ranges:
        return set()
    points = sorted({p for r in ranges for p in r} - {0, _TOP})
    bins = sorted({bisect_left(points, low) + (low in points) for low, _ in ranges})
    held = keys.mapInArrow(_inside(points, bins), "high long, low long").distinct().collect()
    return {(r["high"] + (1 << 63) << 64) + r["low"] + (1 << 63) for r in held}


def splitters(
    keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 64
) -> tuple[list[int], int]:
    """Keys at which the shards 1.. begin, and the rounds it took.

    ``keys``: (high, low, size). A splitter is final once the bytes below it
    are within ``tolerance`` of a mean shard from its target, or at most one
    row lies between its bounds. Once at most ``probes`` rows do, their keys
    are the next probes. At most ``shards * probes`` counts reach the driver a
    round. Among a round's probes the one nearest to the target wins, and
    high halves are settled before low ones are touched, so a group of equal
    texts is cut only if it holds a target and is too large for the tolerance.
    """
    stats = keys.agg(F.sum("size"), F.count(F.lit(1)), F.min("low"), F.max("low")).first()
    total, rows, least_id, most_id = (int(x or 0) for x in stats)
    targets = [total * i // shards for i in range(1, shards)]
    if not total:
        return [0] * len(targets), 0
    slack = max(1, int(total / shards * tolerance))
    # a key, bytes and rows below it: the lowest and the highest that may be right
    bounds = [((0, 0, 0), (_TOP, total, rows)) for _ in targets]
    final: list[int | None] = [None] * len(targets)
    rounds = 0
    while None in final:
        few = [(a[0], b[0]) for i, (a, b) in enumerate(bounds) if final[i] is None and b[2] - a[2] <= probes]
        wanted = _keys_within(keys, few)
        for i, ((low, *_), (high, *_)) in enumerate(bounds):
            if final[i] is None and (low, high) not in few:
                coarse = (high - 1 >> 64) > (low >> 64)
                unit = 1 << 64 if coarse else 1
                if not coarse:  # only ids that occur can part the rows of one text
                    same = (low >> 64 << 64) + (1 << 63)
                    low, high = max(low, same + least_id), min(high, same + most_id + 1)
                a, b = -(-low // unit), high // unit
                wanted.update({(a + (b - a) * k // (probes + 1)) * unit for k in range(probes + 2)} - {0, _TOP})
        points = sorted(wanted - {0})
        counted = keys.mapInArrow(_histogram(points), "bin long, bytes long, rows long")
        sums = np.zeros((2, len(points) + 1), np.int64)
        for r in counted.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():
            sums[:, r["bin"]] = r["bytes"], r["rows"]
        size_below, rows_below = np.cumsum(sums, axis=1)[:, :-1].tolist()
        rounds += 1
        for i, target in enumerate(targets):
            if final[i] is not None:
                continue
            known = [bounds[i][0], *zip(points, size_below, rows_below, strict=True), bounds[i][1]]
            known = sorted({k for k in known if bounds[i][0][0] <= k[0] <= bounds[i][1][0]})
            at = bisect_left([k[1] for k in known], target)
            high = known[at]
            low = known[at - 1] if at else high
            near = min((low, high), key=lambda k: abs(k[1] - target))
            if abs(near[1] - target) <= slack or high[2] - low[2] <= 1 or (low, high) == bounds[i]:
                final[i] = near[0]
            bounds[i] = (low, high)
    return [f if f is not None else 0 for f in final], rounds


def _at_or_below(cuts: list[int]) -> Column:
    """Number of cuts at or below a row's key (high, low): its shard. No key reaches a cut at the end of all keys."""
    high, low = F.col("high"), F.col("low")
    signed = lambda half: F.lit(half - (1 << 63)).cast("long")
    passed = [(high > signed(c >> 64)) | ((high == signed(c >> 64)) & (low >= signed(c & (2**64 - 1)))) for c in cuts if c < _TOP]
    return F.array_size(F.filter(F.array(*passed), lambda p: p)) if passed else F.lit(0)


def shard_by_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    tolerance: float = 0.001,
    probes: int = 64,
    carry: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``carry``, or all) with their shard, of nearly equal bytes each.

    Adds ``size`` (UTF-8 bytes of the text, null: none, plus 1), ``shard``
    (0 to shards - 1) and ``slot`` (gapless from 0 in each shard, in key
    order); columns of these names are replaced. Rows come back partitioned
    and sorted by (shard, slot).

    A shard differs from the mean by at most twice the tolerance and one row.
    Rows with equal keys (equal text and id) share a shard; null ids order
    first. An empty table gives an empty result.
    """
    added = ("size", "shard", "slot")
    kept = [c for c in carry or docs.columns if c.lower() not in added]
    text, ident = F.col(text_col), F.col(id_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    keyed = docs.select(
        F.xxhash64(text).alias("high"),
        F.coalesce(ident.cast("long"), F.lit(-(1 << 63))).alias("low"),
        size.alias("size"),
        F.monotonically_increasing_id().alias("tie"),
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
    )
    keys = shared_table(keyed.select("high", "low", "size"), "shard-keys")
    cuts, _ = splitters(keys, shards, tolerance, probes)

    placed = keyed.withColumn("shard", _at_or_below(cuts))
    partitions = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["shard", "high", "low", "tie"]
    exchanged = placed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # ids count a partition's rows in their order, below the partition's number
    slotted = shared_table(exchanged.drop("high", "low", "tie").withColumn("at", F.monotonically_increasing_id()), "shards")
    slotted = slotted.withColumn("part", F.shiftright("at", 33))

    # one row for each shard and partition that holds some of it
    held = slotted.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return slotted.join(F.broadcast(offsets), ["shard", "part"]).select(
        *[F.col(f"row.`{c}`") for c in kept],
        "size",
        "shard",
        (F.col("offset") + F.col("at") - F.col("first")).alias("slot"),
    )
