"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so that neighbours share many bits. A
node of the index holds the masked bit pattern that all fingerprints below it
share; a child holds only the bits that its parent does not. A search carries
the differences counted on the way down and leaves a whole node once they
exceed the limit, or takes a whole node once no free bit could exceed it.

The top nodes are the distributed part. The 64 bits are cut into ``blocks``;
each choice of blocks that at most ``max_bits`` differences must leave
untouched is a mask, and fingerprints with equal masked bits are one top
node, a Spark group. Two fingerprints within the limit agree under at least
one mask, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercata.llm.common import min_labels, shared_table, split_hot_groups, whole_groups
from mercata.llm.components import components

#: Children of an index node, and pairs held at once in a search.
FAN, FRONTIER = 16, 1 << 20
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """SimHash of a text's word shingles, repeats included (no words: zero)."""
    joined = b" ".join((text or b"").lower().split())
    if not joined:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(ends) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        part = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[a:b], 42) for a, b in part], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), words) for t in texts], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    schema = StructType().add("id", docs.schema[id_col].dataType).add("fp", "long")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def masks(max_bits: int, blocks: int) -> list[int]:
    """The masks under which two fingerprints in reach must agree at least once."""
    if blocks <= max_bits:
        raise ValueError("blocks must exceed max_bits")
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit code in Gray order (as the bits of a signed long)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(total)


def build_index(fps: np.ndarray, groups: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of nodes over Gray-sorted fingerprints, the leaves first.

    ``groups``: start positions of the groups; the last level has one node a
    group. Each level has the nodes' ``pattern`` and ``mask`` (bits shared
    below), ``first`` and ``end`` leaf, and the range of children.
    """
    n = len(fps)
    full = np.full(n, ~np.uint64(0))
    at = np.arange(n)
    levels = [{"pattern": fps, "mask": full, "first": at, "end": at + 1, "from": at, "to": at}]
    ands = ors = fps
    bounds = np.append(groups, n)
    while True:
        sizes = np.diff(bounds)
        per = -(-sizes // FAN)
        starts = np.repeat(bounds[:-1], per) + FAN * _ranges(np.zeros_like(per), per)
        ands, ors = np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)
        mask = ~(ands ^ ors)
        ends = np.append(starts[1:], bounds[-1])
        below = levels[-1]
        levels.append(
            {"pattern": ands & mask, "mask": mask, "first": below["first"][starts], "end": below["end"][ends - 1], "from": starts, "to": ends}
        )
        bounds = np.concatenate(([0], np.cumsum(per)))
        if (per == 1).all():
            return levels


def search(levels: list[dict[str, np.ndarray]], queries: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links of leaves ``queries`` to later leaves of their groups.

    Returns index pairs (a, b) and leaf ranges that are linked as a whole.
    """
    fps, top = levels[0]["pattern"], levels[-1]
    node = np.searchsorted(top["first"], queries, side="right") - 1
    acc = np.bitwise_count((fps[queries] ^ top["pattern"][node]) & top["mask"][node]).astype(np.int64)
    q = queries
    links, wholes = [], []
    for depth in range(len(levels) - 1, 0, -1):
        here, below = levels[depth], levels[depth - 1]
        counts = here["to"][node] - here["from"][node]
        child = _ranges(here["from"][node], counts)
        q, up, acc = np.repeat(q, counts), np.repeat(node, counts), np.repeat(acc, counts)
        own = below["mask"][child] & ~here["mask"][up]
        acc = acc + np.bitwise_count((fps[q] ^ below["pattern"][child]) & own)
        keep = (acc <= max_bits) & (below["end"][child] > q + 1)
        q, node, acc = q[keep], child[keep], acc[keep]
        if depth > 1:
            free = np.bitwise_count(~below["mask"][node])
            sure = acc + free <= max_bits
            if sure.any():
                links.append((q[sure], below["first"][node[sure]]))
                taken = np.unique(node[sure])
                wholes.append((below["first"][taken], below["end"][taken]))
                q, node, acc = q[~sure], node[~sure], acc[~sure]
    links.append((q, node))
    return links, wholes


def link_groups(fps: np.ndarray, groups: np.ndarray, max_bits: int) -> np.ndarray:
    """Per fingerprint the first one of its group that links reach.

    ``fps`` (unsigned) are sorted by Gray rank within each group; ``groups``
    are the groups' start positions.
    """
    levels = build_index(fps, groups)
    sizes = np.diff(np.append(groups, len(fps)))
    cost = np.repeat(sizes, sizes)
    queries = np.flatnonzero(cost > 1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    slices = np.cumsum(cost[queries]) // FRONTIER
    for s in range(int(slices[-1]) + 1 if len(slices) else 0):
        part = queries[np.searchsorted(slices, s) : np.searchsorted(slices, s, side="right")]
        if not len(part):
            continue
        links, wholes = search(levels, part, max_bits)
        for x, y in links:
            a.append(x)
            b.append(y)
        for w in wholes:
            inner = _ranges(w[0], w[1] - w[0] - 1)
            a.append(inner)
            b.append(inner + 1)
    return min_labels(len(fps), np.concatenate(a), np.concatenate(b))


def fingerprint_links(fps: DataFrame, max_bits: int = 4, blocks: int = 6, limit: int = 4096) -> DataFrame:
    """(a, b) links that join exactly the fingerprints chains of links join.

    ``fps``: distinct fingerprints in a column ``fp``. Per group and mask a
    spanning forest leaves the task, never all pairs. Groups of over ``limit``
    fingerprints are compared block by block.
    """
    chosen = masks(max_bits, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])
        ).alias("k"),
    ).select("fp", "k.mask", "k.bits")
    groups = ["mask", "bits", "block_a", "block_b"]
    dealt = (
        split_hot_groups(keyed, ["mask", "bits"], "fp", limit)
        .select(*groups, "fp", gray_rank(F.col("fp")).alias("rank"))
        .repartition(*groups)
        .sortWithinPartitions(*groups, "rank")
        .drop("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, groups):
            codes = t.column("fp").to_numpy()
            label = link_groups(codes.view(np.uint64), starts, max_bits)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.record_batch([pa.array(codes[linked]), pa.array(codes[label[linked]])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    max_bits: int = 4,
    blocks: int = 6,
    limit: int = 4096,
) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits. Rows whose fingerprints
    differ in at most ``max_bits`` bits are linked; ``component_id`` is the
    smallest id that links reach, the row's own included.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Copies and rows that repeat share a fingerprint and so a component.
    A null id gets a row and its component's smallest id that isn't null
    (null if there is none). An empty table gives an empty result. Other
    columns are ignored, whatever their names.

    ``blocks`` sets how fine the top nodes are: 6 blocks share 21 bits a mask,
    7 share 27, 8 share 32. Any value above ``max_bits`` finds every link;
    more blocks keep groups small when there are billions of fingerprints.
    """
    marked = shared_table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    rooted = _rooted(marked, max_bits, blocks, limit)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def _rooted(marked: DataFrame, max_bits: int, blocks: int, limit: int) -> DataFrame:
    """(fp, low, root) of each distinct fingerprint of (id, fp) rows; ``low`` is its smallest id."""
    distinct = shared_table(marked.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    stars = components(fingerprint_links(distinct.select("fp"), max_bits, blocks, limit))
    return distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )


def one_per_component(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    max_bits: int = 4,
    blocks: int = 6,
    limit: int = 4096,
) -> DataFrame:
    """Of each component of ``near_duplicates`` the row with the smallest id, whole.

    A component is known by its fingerprints, not by an id: rows that share an
    id, or have none, but not a text are documents of their own. Null ids come
    last; equal ids go by a digest of the whole row, so a re-run keeps the
    same row. Equal rows are one. An empty table gives an empty result.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    digests = [F.coalesce(F.sha2(c.cast("string").cast("binary"), 256), F.lit("-")) for c in own]
    # the row as one column, so that none of its names can clash with ours
    keyed = docs.select(
        F.struct(*own).alias("whole"),
        F.sha2(F.concat_ws("|", *digests), 256).alias("digest"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("digest").alias("row"))
    marked = shared_table(fingerprints(keyed.select(order.alias("id"), "text"), "id", "text", words), "fingerprints")
    chosen = _rooted(marked, max_bits, blocks, limit).groupBy("root").agg(F.min("low").alias("low"))
    kept = keyed.join(chosen.select(F.col("low.row").alias("digest")), "digest", "left_semi").dropDuplicates(["digest"])
    return kept.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
