"""Line dedup over levelled sorted runs of line hashes.

The store keeps (line hash, documents) rows in runs sorted by hash. Each new
batch anti-joins the lines that the runs already know as frequent and adds
the rest as a run of level 0; once a level holds ``fanout`` runs, they are
merged into one run of the next level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercata.llm.common import shared_folder, shared_table

#: At most so many keys can each hold this part of all (document, line) pairs.
HEAVY_PART = 2000


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of every line: ASCII white space stripped, A-Z lower-cased."""
    return [line.strip() for line in (text or b"").lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars


def _text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _doc_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    keys = set(line_keys(text))
    return {xxhash.xxh3_128_digest(k) for k in keys if k and _long_enough(k, min_chars)}


def _counter(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple[int, bytes]] = Counter()
            for part, text in zip(b.column(0).to_pylist(), _text_bytes(b.column(1)), strict=True):
                seen.update((part, k) for k in _doc_keys(text, min_chars))
            yield pa.record_batch(
                [
                    pa.array([p for p, _ in seen], pa.int32()),
                    pa.array([k for _, k in seen], pa.binary()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                names=["batch", "key", "n"],
            )

    return count


def line_counts(docs: DataFrame, batch: str, text_col: str, min_chars: int) -> DataFrame:
    """(batch, key, n): in how many documents of the batch a line occurs.

    Lines are counted within each Arrow batch first, so that a line that a
    third of all documents share reaches the shuffle as a few rows.
    """
    counted = docs.select(batch, text_col).mapInArrow(
        _counter(min_chars), "batch int, key binary, n long"
    )
    return counted.groupBy("batch", "key").agg(F.sum("n").alias("n"))


class LineRuns:
    """Levelled sorted runs of (key, n), each a Parquet folder sorted by key."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("key binary, n long").parquet(path)

    def _write(self, rows: DataFrame, level: int) -> None:
        path = shared_folder(self.spark, f"line-run-{level}")
        rows.select("key", "n").sortWithinPartitions("key").write.option("compression", "zstd").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def totals(self) -> DataFrame:
        """(key, n) over all runs: a saturated key counts at least ``min_docs``."""
        runs = [self._read(p) for level in self.levels for p in level]
        if not runs:
            return self.spark.createDataFrame([], "key binary, n long")
        return reduce(DataFrame.unionByName, runs).groupBy("key").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        return self.totals().where(F.col("n") >= self.min_docs)

    def add(self, counts: DataFrame) -> None:
        """Anti-join a batch's lines with those known as frequent, add the rest."""
        if self.levels:
            counts = counts.join(self.frequent().select("key"), "key", "left_anti")
        self._write(counts.repartition("key"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs = [self._read(p) for p in self.levels[level]]
            merged = reduce(DataFrame.unionByName, runs).groupBy("key").agg(F.sum("n").alias("n"))
            self.levels[level] = []
            self._write(merged, level + 1)
            level += 1


def _pairs(min_chars: int, heavy: frozenset[bytes]) -> Callable:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            keys: list[bytes] = []
            for i, text in enumerate(_text_bytes(b.column(1))):
                found = _doc_keys(text, min_chars) - heavy
                at.extend([i] * len(found))
                keys.extend(found)
            yield pa.record_batch(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary())],
                names=["id", "key"],
            )

    return pairs


def _rewriter(min_chars: int, heavy: frozenset[bytes]) -> Callable:
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lines, dropped = [], [], []
            texts = _text_bytes(b.column(1))
            for text, own in zip(texts, b.column(2).to_pylist(), strict=True):
                drop = heavy.union(own or ())
                split = (text or b"").split(b"\n")
                kept = split
                if drop:
                    kept = [
                        line
                        for line, k in zip(split, line_keys(text), strict=True)
                        if not (k and _long_enough(k, min_chars) and xxhash.xxh3_128_digest(k) in drop)
                    ]
                out.append(b"\n".join(kept))
                lines.append(len(split))
                dropped.append(len(split) - len(kept))
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array(out, pa.binary()).cast(pa.string()),
                    pa.array(lines, pa.int64()),
                    pa.array(dropped, pa.int64()),
                ],
                names=["row", "text", "n_lines", "n_dropped"],
            )

    return rewrite


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 3,
    fanout: int = 2,
) -> DataFrame:
    """Drop, in every document, each line that at least ``min_docs`` documents hold.

    Two lines are the same if their keys are: ASCII white space stripped at
    both ends, A-Z lower-cased; keys of under ``min_chars`` code points never
    count. Returns the rows of ``docs`` with the text of the lines kept, plus
    ``n_lines`` and ``n_dropped`` (columns of these names are replaced).

    Each row is a document, rows that repeat too. Null and empty texts have
    one empty line and come back as ''. Null ids are an id like any other. An
    empty table gives an empty result. Other columns pass unchanged.

    The documents arrive in ``batches`` by a hash of the row, all of them
    counted. The 128-bit keys of lines travel, never the lines. A key that
    holds 1 / HEAVY_PART of all (document, line) pairs, counted over all
    batches, is told to the tasks directly (at most HEAVY_PART such keys exist,
    16 bytes each); all others are joined on the key, so that no key is large
    there. What a document loses comes back under its id and a hash of its
    text: documents that share an id, or have none, are rows of their own. (Two
    texts of one id and hash would both be told both texts' lines, which leave
    every document anyway.)
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("batch")), F.lit(batches)).cast("int")
    staged = shared_table(
        line_counts(docs.select(batch.alias("batch"), F.col(text_col).alias("text")), "batch", "text", min_chars),
        "line-counts",
    )
    runs = LineRuns(spark, min_docs, fanout)
    for i in range(batches):
        runs.add(staged.where(F.col("batch") == i).select("key", "n"))
    frequent = shared_table(runs.frequent().select("key"), "frequent-lines")

    # the runs stop counting a saturated line, so what is heavy is asked of the batches' own counts
    pairs_total = staged.agg(F.sum("n")).first()[0] or 0
    least = max(min_docs, -(-pairs_total // HEAVY_PART))
    hot = staged.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    heavy = frozenset(bytes(r[0]) for r in hot.collect())
    told = spark.createDataFrame([(bytearray(k),) for k in sorted(heavy)], "key binary")
    rare = frequent.join(F.broadcast(told), "key", "left_anti")

    id_type = docs.schema[id_col].dataType
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    owned = (
        docs.select(row.alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_pairs(min_chars, heavy), StructType().add("id", StructType().add("id", id_type).add("h", "long")).add("key", "binary"))
        .join(rare, "key")
        .groupBy("id.id", "id.h")
        .agg(F.collect_set("key").alias("keys"))
    )
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    others = [c for c in kept if c != text_col]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(text_col).alias("text"),
        F.col(id_col).alias("row_id"),
        F.xxhash64(F.col(text_col)).alias("row_h"),
    )
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_h") == F.col("h"))
    joined = rows.join(owned, same, "left").select("row", "text", "keys")
    schema = StructType().add("row", joined.schema["row"].dataType).add("text", "string")
    out = joined.mapInArrow(_rewriter(min_chars, heavy), schema.add("n_lines", "long").add("n_dropped", "long"))
    return out.select(
        *[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in kept],
        "n_lines",
        "n_dropped",
    )
