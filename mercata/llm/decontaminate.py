"""Benchmark decontamination by a prefix-filtered set join.

An item's text is cut into windows of consecutive words. A window's elements
are its word shingles, ordered by rarity over all documents. Containment of
the whole window needs every one of them, so a prefix of one element, the
rarest, is enough to find each candidate. A candidate is placed by the
element's offset, must lie inside the document (length and positional
bounds), and is then compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII bytes: letters lower-cased, digits kept, everything else a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of a document that are compared at once.
CHUNK = 1 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters and digits and of non-ASCII code points."""
    return (text or b"").translate(_TABLE).split()


def item_windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Windows of ``size`` consecutive words; one window if there are fewer, none if none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def shingle_codes(ids: np.ndarray, length: int) -> np.ndarray:
    """A code for each run of ``length`` word numbers; runs with an unknown word (0) get 0."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for i in range(length):
        part = ids[i : i + n]
        known &= part > 0
        code = (code + part.astype(np.uint64)) * _MIX
        code ^= code >> np.uint64(29)
    return np.where(known, np.maximum(code, np.uint64(1)), np.uint64(0))


@dataclass
class Block:
    """A bounded part of the windows, with what a task needs to find them."""

    vocabulary: dict[bytes, int]
    #: By window length: word numbers of the windows, one row a window.
    windows: dict[int, np.ndarray]
    #: By window length: the items that hold each window.
    items: dict[int, list[list[int]]]
    #: By window length: sorted codes of the prefix shingles, their offsets and windows.
    prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def shingle_length(window: int, shingle: int) -> int:
    return min(shingle, window)


def make_block(held: dict[tuple[bytes, ...], list[int]]) -> Block:
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[bytes, ...]]] = {}
    for w in held:
        by_length.setdefault(len(w), []).append(w)
        for x in w:
            vocabulary.setdefault(x, len(vocabulary) + 1)
    windows = {
        n: np.array([[vocabulary[x] for x in w] for w in ws], dtype=np.int64) for n, ws in by_length.items()
    }
    return Block(vocabulary, windows, {n: [held[w] for w in ws] for n, ws in by_length.items()}, {})


def window_shingles(block: Block, shingle: int) -> dict[int, np.ndarray]:
    """By window length: the shingle codes, one row a window."""
    return {
        n: np.stack([shingle_codes(row, shingle_length(n, shingle)) for row in rows]) for n, rows in block.windows.items()
    }


def choose_prefixes(block: Block, shingle: int, counts: dict[int, dict[int, int]]) -> None:
    """Keep each window's rarest shingle; ties go to the first."""
    for n, codes in window_shingles(block, shingle).items():
        own = counts.get(shingle_length(n, shingle), {})
        values, back = np.unique(codes, return_inverse=True)
        rarity = np.array([own.get(int(v), 0) for v in values], dtype=np.int64)[back].reshape(codes.shape)
        at = rarity.argmin(axis=1)
        prefix = codes[np.arange(len(codes)), at]
        order = np.argsort(prefix, kind="stable")
        block.prefixes[n] = (prefix[order], at[order], order)


def _numbers(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get = vocabulary.get
    return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def find(block: Block, ids: np.ndarray, shingle: int) -> tuple[np.ndarray, set[int]]:
    """Positions of ``ids`` inside any occurrence of a window, and the items found."""
    n = len(ids)
    edges = np.zeros(n + 1, np.int64)
    items: set[int] = set()
    for length, (prefix, offsets, rows) in block.prefixes.items():
        codes = shingle_codes(ids, shingle_length(length, shingle))
        windows, found = block.windows[length], np.zeros(len(rows), bool)
        for begin in range(0, len(codes), CHUNK):
            part = codes[begin : begin + CHUNK]
            low = np.searchsorted(prefix, part)
            hits = np.flatnonzero((part > 0) & (prefix[np.minimum(low, len(prefix) - 1)] == part))
            if not len(hits):
                continue
            low = low[hits]
            many = np.searchsorted(prefix, part[hits], side="right") - low
            # windows that share a prefix are tried one after another
            for k in range(int(many.max())):
                sure = many > k
                at = low[sure] + k
                start = begin + hits[sure] - offsets[at]
                inside = (start >= 0) & (start + length <= n)
                start, window = start[inside], rows[at[inside]]
                good = np.ones(len(start), bool)
                for j in range(length):
                    good[good] = ids[start[good] + j] == windows[window[good], j]
                np.add.at(edges, start[good], 1)
                np.add.at(edges, start[good] + length, -1)
                found[window[good]] = True
        for w in np.flatnonzero(found).tolist():
            items.update(block.items[length][w])
    return np.flatnonzero(np.cumsum(edges[:-1]) > 0), items


def _count(block: Block, shingle: int) -> Callable:
    codes: dict[int, np.ndarray] = {}
    for n, c in window_shingles(block, shingle).items():
        length = shingle_length(n, shingle)
        codes[length] = np.union1d(codes.get(length, np.zeros(0, np.uint64)), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {length: np.zeros(len(c), np.int64) for length, c in codes.items()}
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                ids = _numbers(words_of(text.as_py()), block.vocabulary)
                for length, wanted in codes.items():
                    own = shingle_codes(ids, length)
                    own = own[own > 0]
                    at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    sums[length] += np.bincount(at[wanted[at] == own], minlength=len(wanted))
        for length, c in codes.items():
            held = np.flatnonzero(sums[length])
            yield pa.record_batch(
                [
                    pa.array(np.full(len(held), length, np.int32)),
                    pa.array(c[held].view(np.int64)),
                    pa.array(sums[length][held]),
                ],
                names=["length", "code", "n"],
            )

    return run


def corpus_counts(docs: DataFrame, text_col: str, block: Block, shingle: int) -> dict[int, dict[int, int]]:
    """How often each shingle of the block's windows occurs in all documents.

    Each task counts its own documents; at most one row a shingle of the block
    reaches the driver, which is as bounded as the block.
    """
    rows = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(_count(block, shingle), "length int, code long, n long")
        .groupBy("length", "code")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["length"], {})[r["code"] & 0xFFFFFFFFFFFFFFFF] = r["n"]
    return out


def blocks_of(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Block]:
    """The windows of all items in blocks of at most about ``block_words`` words.

    Items stream through the driver partition by partition; one block is held
    at a time.
    """
    held: dict[tuple[bytes, ...], list[int]] = {}
    size = 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        for w in item_windows(words_of(bytes(r["t"]) if r["t"] is not None else None), window):
            size += len(w)
            own = held.setdefault(w, [])
            if r["i"] is not None and (not own or own[-1] != r["i"]):
                own.append(r["i"])
        if size >= block_words:
            yield make_block(held)
            held, size = {}, 0
    if held:
        yield make_block(held)


def _mark(block: Block | None, shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for text in b.column(1).cast(pa.binary()):
                words = words_of(text.as_py())
                hit, found = np.zeros(0, np.int64), set()
                if block is not None:
                    hit, found = find(block, _numbers(words, block.vocabulary), shingle)
                n_words.append(len(words))
                n_hit.append(len(hit))
                items.append(sorted(found))
                cuts = np.flatnonzero(np.diff(hit) > 1)
                starts = np.concatenate((hit[:1], hit[cuts + 1]))
                ends = np.concatenate((hit[cuts], hit[-1:])) + 1
                spans.append(np.stack((starts, ends), axis=1).reshape(-1).tolist())
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(pa.int64())),
                ],
                names=["row", "n_words", "n_hit", "items", "spans"],
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join one row's findings of several blocks."""
    for b in batches:
        n_hit, items, spans = [], [], []
        for own, held in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            items.append(sorted({i for x in held for i in x}))
            flat = sorted((x[i], x[i + 1]) for x in own for i in range(0, len(x), 2))
            joined: list[list[int]] = []
            for s, e in flat:
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([s, e])
            spans.append([v for span in joined for v in span])
            n_hit.append(sum(e - s for s, e in joined))
        yield pa.record_batch(
            [b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int64()))],
            names=["row", "n_words", "n_hit", "items", "spans"],
        )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_words: int = 2_000_000,
) -> DataFrame:
    """``docs`` with what is found of ``items`` in each text.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``items`` (sorted ids of the items with occurring windows) and ``spans``
    (flat start, end word positions of the hit runs); columns of these names
    are replaced.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one. A-Z are lower-cased; words are runs of ASCII letters, digits
    and non-ASCII code points. Null and empty texts have no words, items
    without words have no windows. Rows that repeat each get their own result;
    items with equal texts are each found; null item ids are left out of
    ``items`` (their windows still hit). Empty tables give empty findings.

    The windows are sent to the tasks in blocks of about ``block_words``
    words, so that what is broadcast stays bounded however large ``items`` is;
    a second block means a second pass over the documents, and the passes'
    findings are then joined by row.
    """
    added = ("n_words", "n_hit", "items", "spans")
    kept = [c for c in docs.columns if c.lower() not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = docs.select(row, F.col(text_col).alias("text"))
    findings = "n_words long, n_hit long, items array<long>, spans array<long>"
    schema = StructType().add("row", rows.schema["row"].dataType)
    for f in StructType.fromDDL(findings):
        schema = schema.add(f)

    blocks = blocks_of(items, item_id_col, item_text_col, window, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is not None:
        choose_prefixes(first, shingle, corpus_counts(docs, text_col, first, shingle))
    if second is None:
        out = rows.mapInArrow(_mark(first, shingle), schema)
    else:
        # Equal texts have equal findings, so the passes are joined by the text's digest.
        keyed = docs.select(F.sha2(F.col(text_col), 256).alias("row"), F.col(text_col).alias("text")).where("row IS NOT NULL")
        passes = None
        block: Block | None = first
        while block is not None:
            if not block.prefixes:
                choose_prefixes(block, shingle, corpus_counts(docs, text_col, block, shingle))
            hits = keyed.mapInArrow(_mark(block, shingle), "row string, " + findings).where("n_hit > 0").dropDuplicates(["row"])
            passes = hits if passes is None else passes.unionByName(hits)
            block, second = second, next(blocks, None)
        found = (
            passes.groupBy("row")
            .agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("a"), F.collect_list("items").alias("b"))
            .mapInArrow(_merge, "row string, " + findings)
            .select(F.col("row").alias("digest"), "n_hit", "items", "spans")
        )
        none = F.array().cast("array<long>")
        out = (
            rows.mapInArrow(_mark(None, shingle), schema)
            .select("row", "n_words", F.sha2(F.col(f"row.`{text_col}`"), 256).alias("digest"))
            .join(found, "digest", "left")
            .select(
                "row",
                "n_words",
                F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                F.coalesce("items", none).alias("items"),
                F.coalesce("spans", none).alias("spans"),
            )
        )
    return out.select(*[F.col(f"row.`{c}`") for c in kept], *added)

