"""Prefix trie of conversations by range minima over sorted LCPs.

Conversations are sequences of turn keys. They are sorted over the whole
cluster; two neighbours' common prefix length is their LCP. A prefix is a
node, and its members are the interval of sorted rows around any of them in
which no LCP falls below the prefix's depth. Every candidate prefix finds the
two ends of its interval by itself, by binary search over a sparse table of
range minima; nothing is kept on a stack and no candidate waits for another.

Sorted rows are cut into ranges, each with its own sparse table. A node whose
interval reaches over a cut gives one piece a range; all its figures are sums
or minima over pieces, as every row knows its true LCP, also across the cut.
So a first turn that a third of all conversations share costs no task more
than its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.common import shared_table

WORD = r"[^\x20\x09-\x0D]+"
NONE = np.iinfo(np.int64).max

PIECE = (
    "part int, node binary, parent binary, depth long, open boolean, conv_id long, parent_conv_id long, parent_open boolean, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends array<long>, ends_sha256 string"
)
NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(
    turns: DataFrame, key: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, turns): each conversation's turns in order, as (key, words).

    ``key`` is the MD5 of role and text, ``words`` the number of words of the
    text. Null roles and texts are ''. Turns are ordered by turn, nulls first,
    then by key; rows that repeat are turns of their own.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    ordered = F.sort_array(F.collect_list(row))
    return turns.groupBy(F.col(key).cast("long").alias("id")).agg(
        F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns")
    )


def rebuild(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Give conversations shared beginnings.

    Conversation c gets the first h turns of conversation c - c % ``every``
    (all if it has fewer, none if it is absent) in place of its own first h; h
    is the unsigned crc32 of c in decimal, modulo ``heads``. A null id keeps
    its own turns.
    """
    base = convs.where(F.col("id") % every == 0).select(
        F.col("id").alias("base"), F.slice("turns", 1, heads - 1).alias("head")
    )
    h = F.coalesce((F.crc32(F.col("id").cast("string").cast("binary")) % heads).cast("int"), F.lit(0))
    joined = convs.withColumn("base", F.col("id") - F.col("id") % every).join(base, "base", "left").withColumn("h", h)
    none = F.array().cast(convs.schema["turns"].dataType)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share; -1 if there is no other array."""
    least = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.when(a.isNull() | b.isNull(), F.lit(-1)).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, least))


class RangeMinima:
    """Sparse table: ``levels[k][i]`` is the minimum of ``values[i : i + 2 ** k]``."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (w := 2 ** (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - w], last[w:]))

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minima of values[begin:end], each of at least one value."""
        level = np.frexp(end - begin)[1] - 1
        out = np.empty(len(begin), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][begin[at]], self.levels[k][end[at] - 2**k])
        return out

    def reach_right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last r from ``start`` on with values[start + 1 .. r] all at ``bound`` or above."""
        r = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            row, width = self.levels[k], 2**k
            fits = r + width < len(self.levels[0])
            ok = fits & (row[np.where(fits, r + 1, 0)] >= bound)
            r[ok] += width
        return r

    def reach_left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first l up to ``start`` with values[l + 1 .. start] all at ``bound`` or above."""
        left = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            row, width = self.levels[k], 2**k
            fits = left - width >= 0
            ok = fits & (row[np.where(fits, left - width + 1, 0)] >= bound)
            left[ok] -= width
        return left


def neighbour_lcps(keys: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """LCP of every row with the row before it (0 for the first); ``keys`` holds all rows' turns in two words each."""
    lcp = np.zeros(len(size), dtype=np.int64)
    at = np.arange(1, len(size))
    depth = 0
    while len(at):
        at = at[(size[at] > depth) & (size[at - 1] > depth)]
        at = at[(keys[start[at] + depth] == keys[start[at - 1] + depth]).all(axis=1)]
        depth += 1
        lcp[at] = depth
    return lcp


def _node_names(keys: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray, depths: np.ndarray) -> list[bytes]:
    """A 128-bit name of each prefix (row, depth), rows ascending: a hash chained over the turns."""
    raw, out, row, chain = keys.tobytes(), [], -1, []
    for i, d in zip(rows.tolist(), depths.tolist(), strict=True):
        if i != row:
            row, state, chain = i, hashlib.md5(usedforsecurity=False), []
            for k in range(start[i], start[i] + size[i]):
                chain.append(state.digest())
                state.update(raw[16 * k : 16 * k + 16])
            chain.append(state.digest())
        out.append(chain[d])
    return out


def range_nodes(t: pa.Table) -> pa.Table:
    """The pieces of all nodes that the sorted rows of one range hold."""
    t = t.take(pa.array(np.argsort(t.column("pos").to_numpy(), kind="stable"))).combine_chunks()
    n = t.num_rows
    ids = t.column("id").combine_chunks()
    known = np.asarray(ids.is_valid())
    ids = ids.fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = t.column("keys").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    flat = lists.flatten().cast(pa.binary(16))
    keys = np.frombuffer(b"".join(flat.to_pylist()), dtype=np.uint64).reshape(-1, 2)
    words = np.concatenate([[0], np.cumsum(t.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False))]).astype(np.int64)
    lcp = neighbour_lcps(keys, start, size)
    lcp[0] = t.column("before")[0].as_py()
    after = np.append(lcp[1:], t.column("after")[0].as_py())
    minima, smallest = RangeMinima(lcp), RangeMinima(ids)

    # Candidates: the prefixes that a row has first here; the first row has all of its own here.
    first = np.maximum(lcp + 1, 0)
    first[0] = 0
    counts = size - first + 1
    offset = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    row = np.repeat(np.arange(n), counts)
    depth = np.arange(len(row)) - offset[row] + first[row]
    left = minima.reach_left(row, depth)
    right = minima.reach_right(row, depth)
    new = depth > lcp[row]  # not the rest of a node that an earlier range began
    open_ = ~new | ((right == n - 1) & (after[n - 1] >= depth))

    # Each candidate's parent prefix searches its own left end: that row has it first.
    has_parent = depth > 0
    p_row = minima.reach_left(row, np.maximum(depth - 1, 0))
    parent = np.where(has_parent, offset[p_row] + depth - 1 - first[p_row], -1)
    children = np.bincount(parent[has_parent & new], minlength=len(row))

    total = words[start + size] - words[start]  # words of a whole row
    introduced = total - (words[start + np.minimum(np.maximum(lcp, 0), size)] - words[start])  # of nodes that a row begins
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    t_sum, i_sum, l_sum = sums(total), sums(introduced), sums(after < size)
    above = words[start[row] + np.maximum(depth - 1, 0)] - words[start[row]]
    members = right - left + 1
    below = np.where(new, total[row] - above, introduced[row]) + i_sum[right + 1] - i_sum[row + 1]
    saved = t_sum[right + 1] - t_sum[left] - members * above - below

    conv = smallest.least(left, right + 1)
    # Members that end at a node come first in its interval, by ascending id.
    none = hashlib.sha256(b"").hexdigest()
    same = RangeMinima(np.where((lcp == size) & (np.append(0, size[:-1]) == size), 1, 0))
    ends_here = size[left] == depth
    last = same.reach_right(left, np.ones(len(row), dtype=np.int64))
    shas, lists_out = [], []
    for a, b, e, o in zip(left.tolist(), last.tolist(), ends_here.tolist(), open_.tolist(), strict=True):
        own = ids[a : b + 1][known[a : b + 1]] if e else ids[:0]
        lists_out.append(own if o else None)
        shas.append(None if o else hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest() if len(own) else none)
    name = _node_names(keys, start, size, row, depth)
    number = lambda v: pa.array(v, pa.int64(), mask=v == NONE)
    p = np.maximum(parent, 0)
    local = has_parent & ~open_[p]
    return pa.table(
        {
            "part": pa.array(np.full(len(row), t.column("part")[0].as_py()), pa.int32()),
            "node": pa.array(name, pa.binary()),
            "parent": pa.array([name[j] if j >= 0 else None for j in parent.tolist()], pa.binary()),
            "depth": pa.array(depth, pa.int64()),
            "open": pa.array(open_),
            "conv_id": number(conv),
            "parent_conv_id": number(np.where(local, conv[p], NONE)),
            "parent_open": pa.array(has_parent & open_[p]),
            "n_convs": pa.array(members, pa.int64()),
            "n_children": pa.array(children, pa.int64()),
            "n_leaves": pa.array(l_sum[right + 1] - l_sum[left], pa.int64()),
            "saved_tokens": pa.array(saved, pa.int64()),
            "ends": pa.array(lists_out, pa.list_(pa.int64())),
            "ends_sha256": pa.array(shas, pa.string()),
        }
    )


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes from pieces sorted by node and range; a piece at a time is held, and the running hash of the ends."""
    now = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{**now, "ends_sha256": sha.hexdigest()}],
            pa.schema([("node", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())]),
        )

    for batch in batches:
        for i in range(batch.num_rows):
            x = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("part", "ends")}
            if now is None or x["node"] != now["node"]:
                if now is not None:
                    yield done()
                now, sha, some = x, hashlib.sha256(), False
            else:
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[c] += x[c]
                now["conv_id"] = min((v for v in (now["conv_id"], x["conv_id"]) if v is not None), default=None)
            for v in batch.column("ends")[i].values.to_numpy(zero_copy_only=False).tolist():
                sha.update((b"," if some else b"") + str(v).encode())
                some = True
    if now is not None:
        yield done()


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The prefix trie of (id, turns) conversations, a row per node.

    ``turns`` is an array of (key 16 bytes, words). A node is a distinct
    sequence of first turns, from the empty one on; its members are the
    conversations that begin with it. Columns: ``node`` (128-bit name),
    ``parent`` (its parent's), ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (nodes
    without children in the subtree, itself included), ``saved_tokens``
    (words that sharing saves in the subtree: every node's members less one,
    times the words of its last turn) and ``ends_sha256`` (of the ids of the
    members that end here, ascending, comma-joined).

    Ids are distinct, as ``sequences`` makes them. A null id is a member like
    any other, but it's neither a smallest member, unless alone, nor among
    ``ends_sha256``. Conversations without turns end at the root. Other
    columns are ignored; an empty table has no root and gives no rows. A
    conversation has to fit one row, at 24 bytes a turn.
    """
    flat = convs.select("id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))
    placed = flat.repartitionByRange("keys", "id").sortWithinPartitions("keys", "id")
    rows = shared_table(
        placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "sorted-conversations"
    )
    # A row per range with its first and last conversation: as many rows as there are ranges.
    ranges = rows.groupBy("part").agg(F.min_by("keys", "pos").alias("head"), F.max_by("keys", "pos").alias("tail"))
    order = Window.orderBy("part")
    cuts = ranges.select(
        "part",
        common_prefix(F.lag("tail").over(order), F.col("head")).alias("before"),
        common_prefix(F.col("tail"), F.lead("head").over(order)).alias("after"),
    )
    placed = rows.join(F.broadcast(cuts), "part")
    pieces = shared_table(placed.groupBy("part").applyInArrow(range_nodes, PIECE), "trie-pieces")

    # Nodes that reach over a cut: a piece a range each, joined in order.
    crossing = pieces.where("open")
    joined = shared_table(
        crossing.select("part", "node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
        .repartition("node")
        .sortWithinPartitions("node", "part")
        .mapInArrow(_join_pieces, NODE),
        "trie-crossing",
    )
    known = joined.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_known"))
    # A range meets its own crossing nodes only, so that no parent is a hot key.
    per_range = crossing.select("part", F.col("node").alias("parent")).join(known, "parent")
    columns = ["node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = pieces.where("not open").join(per_range, ["part", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_known"))
    over = joined.join(known, "parent", "left").withColumn("parent_conv_id", F.col("parent_known"))
    return whole.select(columns).unionByName(over.select(columns))
