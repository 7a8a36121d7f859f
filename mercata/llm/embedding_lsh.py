"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length one. Each hash adds a random offset to a random
Gaussian projection and divides by a width; a table joins several such hashes
to a bucket number. Vectors that share a bucket in any table are candidates
and are linked by their exact cosine.

What travels to the buckets is an id and 128 sign bits of random projections,
never the vector. The bits tell which candidates can reach the cosine at all
(five standard deviations of leeway); those hang together in families, named
by their least id. Vectors then travel once a family, to be compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercata.llm.common import min_labels, shared_table, split_hot_groups, whole_groups
from mercata.llm.components import components

#: Rows of a block of cosines, and sign bits of a sketch.
BLOCK, SIGNS = 1024, 128


def signatures(unit: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """Bucket numbers (rows x tables) of unit vectors."""
    dims = unit.shape[1]
    rng = np.random.default_rng([seed, dims])
    axes = rng.standard_normal((dims, tables * hashes))
    shift = rng.uniform(0, width, tables * hashes)
    cells = np.floor((unit @ axes + shift) / width).astype(np.int64)
    mixed = np.zeros((len(unit), tables), np.uint64)
    for i in range(hashes):
        mixed = (mixed ^ cells[:, i::hashes].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return (mixed >> np.uint64(33)).astype(np.int32)


def usable(column: str) -> Column:
    """Whether a vector has a direction: parts present and finite, not all zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def _units(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """(rows x 2) words of ``SIGNS`` sign bits: two vectors differ in each with probability angle / pi."""
    planes = np.random.default_rng([seed, unit.shape[1], SIGNS]).standard_normal((unit.shape[1], SIGNS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.uint64)


def most_signs(cosine: float) -> int:
    """Sign bits in which vectors at the cosine differ at most, five standard deviations up."""
    part = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(np.ceil(SIGNS * part + 5 * np.sqrt(SIGNS * part * (1 - part)))) + 1


def signed(classes: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """(id, dims, buckets, s0, s1): a row per class, its bucket in each table and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                b = whole.slice(begin, BLOCK)
                dims = np.array([len(v) for v in b.column(1)])
                for d in np.unique(dims).tolist():
                    part = b.take(pa.array(np.flatnonzero(dims == d)))
                    unit = _units([np.array(v.as_py(), dtype="<f8").tobytes() for v in part.column(1)])
                    sig, bits = signatures(unit, tables, hashes, width, seed), sketches(unit, seed).view(np.int64)
                    yield pa.record_batch(
                        [part.column(0), pa.array(np.full(len(sig), d, np.int32)), pa.array(list(sig), pa.list_(pa.int32())), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                        names=["id", "dims", "buckets", "s0", "s1"],
                    )

    return classes.select("id", "vector").mapInArrow(run, "id long, dims int, buckets array<int>, s0 long, s1 long")


def _close(words: np.ndarray, one: np.ndarray, two: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in one, j in two) whose sketches differ in at most ``most`` bits."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, len(one), BLOCK):
        i = one[begin : begin + BLOCK]
        for other in range(0, len(two), BLOCK):
            j = two[other : other + BLOCK]
            x, y = np.nonzero(np.bitwise_count(words[i, None, :] ^ words[None, j, :]).sum(axis=2, dtype=np.int32) <= most)
            a.append(i[x])
            b.append(j[y])
    return np.concatenate(a), np.concatenate(b)


def _sides(t: pa.Table, s: int, e: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a group to be compared with one another: all with all, or those of one block with the other's."""
    everyone = np.arange(e - s)
    first, last = t.column("block_a")[s].as_py(), t.column("block_b")[s].as_py()
    if first == last:
        return everyone, everyone, True
    left = t.column("block").slice(s, e - s).to_numpy() == first
    return everyone[left], everyone[~left], False


def families(dealt: DataFrame, most: int) -> DataFrame:
    """(dims, root, id): classes of a bucket that hang together by their sketches; ``root`` is their least id."""
    groups = ["dims", "tab", "bucket", "block_a", "block_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, groups, 8192):
            ends = np.append(starts[1:], t.num_rows)
            ids, dims = t.column("id").to_numpy(), t.column("dims").to_numpy()
            words = np.stack([t.column(c).to_numpy() for c in ("s0", "s1")], axis=1).view(np.uint64)
            at, root = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                one, two, alike = _sides(t, s, e)
                a, b = _close(words[s:e], one, two, most)
                if alike:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    # labels are places; places follow the ids, so that a family's least place is its least id
                    order = np.argsort(ids[s:e], kind="stable")
                    rank = np.empty(e - s, np.int64)
                    rank[order] = np.arange(e - s)
                    label = min_labels(e - s, rank[a], rank[b])
                    member = np.unique(np.concatenate([a, b]))
                    at.append(s + member)
                    root.append(ids[s + order[label[rank[member]]]])
            x = np.concatenate(at)
            yield pa.record_batch([pa.array(dims[x]), pa.array(np.concatenate(root)), pa.array(ids[x])], names=["dims", "root", "id"])

    placed = dealt.repartition(*groups).sortWithinPartitions(*groups)
    return placed.mapInArrow(run, "dims int, root long, id long").distinct()


def _pairs(unit: np.ndarray, one: np.ndarray, two: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in one, j in two) at or above the cosine."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, len(one), BLOCK):
        i = one[begin : begin + BLOCK]
        for other in range(0, len(two), BLOCK):
            j = two[other : other + BLOCK]
            x, y = np.nonzero(unit[i] @ unit[j].T >= cosine)
            a.append(i[x])
            b.append(j[y])
    return np.concatenate(a), np.concatenate(b)


def _met_before(earlier: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs (a, b) share one of the earlier families that each row is in."""
    if not any(earlier):
        return np.zeros(len(a), bool)
    sets = [frozenset(x) for x in earlier]
    busy = np.array([bool(x) for x in sets])
    out = busy[a] & busy[b]
    for k in np.flatnonzero(out).tolist():
        out[k] = not sets[a[k]].isdisjoint(sets[b[k]])
    return out


def family_links(dealt: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root): per class what one family adds to it.

    ``links`` counts the vectors linked in this family and in none with a
    smaller root, so that sums over all families count every link once;
    ``root`` is the first class of the family that links reach.
    """
    groups = ["dims", "root", "block_a", "block_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, groups, 4096):
            ends = np.append(starts[1:], t.num_rows)
            ids, weight = (t.column(c).to_numpy() for c in ("id", "weight"))
            vectors, earlier = t.column("vector"), t.column("earlier")
            at, more, root = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                unit = _units([np.array(v, dtype="<f8").tobytes() for v in vectors.slice(s, e - s).to_pylist()])
                one, two, alike = _sides(t, s, e)
                a, b = _pairs(unit, one, two, cosine)
                if alike:
                    a, b = a[a < b], b[a < b]
                new = ~_met_before(earlier.slice(s, e - s).to_pylist(), a, b)
                a, b = a[new], b[new]
                if not len(a):
                    continue
                n = np.zeros(e - s, np.int64)
                np.add.at(n, a, weight[s:e][b])
                np.add.at(n, b, weight[s:e][a])
                linked = np.flatnonzero(n)
                label = min_labels(e - s, a, b)
                at.append(s + linked)
                more.append(n[linked])
                root.append(s + label[linked])
            x = np.concatenate(at)
            yield pa.record_batch(
                [pa.array(ids[x]), pa.array(np.concatenate(more)), pa.array(ids[np.concatenate(root)])], names=["id", "links", "root"]
            )

    return (
        dealt.repartition(*groups)
        .sortWithinPartitions(*groups)
        .mapInArrow(run, "id long, links long, root long")
    )


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.95,
    tables: int = 16,
    hashes: int = 12,
    width: float = 2.0,
    seed: int = 7,
    limit: int = 2048,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    Vectors found in a common bucket are linked if their cosine, in double
    precision, is at least ``cosine``; none below it is. ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest id that
    links reach, itself included, ``kept`` tells whether that is the row's
    own. Vectors that are null, zero, empty, or hold null or non-finite parts
    link with nothing; vectors of different lengths are not compared. Rows
    that repeat are vectors like any other and link with each other. An empty
    table gives an empty result; other columns are ignored.

    Two unit vectors at a cosine of 0.95 share a hash of width 2 with
    probability 0.87, so one of 16 tables of 12 hashes with probability 0.97,
    and more above it; of those that share a bucket the sketches lose fewer
    than one in a million. Equal vectors (by 128-bit hashes) are collapsed
    before they are hashed. A bucket or family of over ``limit`` vectors is
    compared block by block.
    """
    part = vectors.schema[vector_col].dataType
    vector = F.col(vector_col) if part.simpleString() in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    # a vector is known by 128 bits; the narrow rows below never carry it
    base = vectors.select(
        F.col(id_col).alias("id"),
        F.xxhash64(vector, F.lit(1)).alias("k1"),
        F.xxhash64(F.lit(2), vector).alias("k2"),
        vector.alias("vector"),
        usable(vector_col).alias("ok"),
    )
    good = base.where("ok").groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"), F.any_value("vector").alias("vector")
    )
    classes = shared_table(good.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    marked = shared_table(signed(classes, tables, hashes, width, seed), "vector-buckets")
    keyed = marked.select("id", "dims", "s0", "s1", F.posexplode("buckets").alias("tab", "bucket"))
    dealt = split_hot_groups(keyed, ["dims", "tab", "bucket"], "id", limit)
    members = shared_table(families(dealt, most_signs(cosine)), "vector-families")
    # the families of a class with a smaller root, where a pair of it may have met before
    all_roots = members.groupBy("id").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    owned = members.join(all_roots, "id").select(
        "dims", "root", "id", F.filter("roots", lambda r: r < F.col("root")).alias("earlier")
    )
    compared = split_hot_groups(shared_table(owned, "vector-members"), ["dims", "root"], "id", limit)
    links = shared_table(family_links(compared.join(classes.select("id", "weight", "vector"), "id"), cosine), "vector-links")
    stars = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = (
        classes.select("id", "k1", "k2", "weight", "low").join(counts, "id", "left")
        .join(stars.select(F.col("node").alias("id"), "root"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    lowest = found.groupBy("root").agg(F.min("low").alias("component_id"))
    named = found.join(lowest, "root").select(
        "k1", "k2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = base.where("ok").select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = base.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
