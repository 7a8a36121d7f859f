"""The prefix trie against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mercata.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [a[3:] for a in sorted(v)] for c, v in convs.items()}
    nodes, ends = {}, {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        base = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), []) if c is not None else []
        turns = base[:h] + v[h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    least = lambda m: min((i for i in m if i is not None), default=None)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    inner = {k[:-1] for k in nodes if k}
    out = []
    for k, m in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        here = sorted(i for i in ends.get(k, []) if i is not None)
        out.append((
            least(m), len(k), least(nodes[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below), sum(x not in inner for x in below),
            sum((len(nodes[x]) - 1) * words(x) for x in below), hashlib.sha256(",".join(map(str, here)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 AS id", "'x' AS turns", "2 AS part", "3 AS node")
    out = prefix_trie.prefix_trie(prefix_trie.rebuild(prefix_trie.sequences(df)))
    return sorted((tuple(r) for r in out.select(COLUMNS).collect()), key=str)


@pytest.fixture
def partitions(spark):
    """Many ranges, so that nodes reach over cuts."""
    keys = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "true"}

    def set_(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield set_
    for k, v in keys.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_matches_brute_force_however_the_ranges_are_cut(spark, partitions, parts):
    rnd = random.Random(parts)
    rows = []
    for c in [*range(-5, 60), None]:
        for _ in range(rnd.randint(1, 6)):
            rows.append((c, rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a", None, "", " x  y z"])))
    partitions(parts)
    assert run(spark, rows, extra=True) == brute(rows)


def test_a_hot_beginning_is_spread_over_ranges(spark, partitions):
    """Most conversations begin alike, many are equal; no range holds them all."""
    rows = [(c, 0, "user", "the same first turn") for c in range(200)]
    rows += [(c, 1, "assistant", "equal answer" if c < 120 else f"own {c}") for c in range(200)]
    partitions(7)
    assert run(spark, rows) == brute(rows)


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, 5, "user", "w " * 100_000), (None, 0, "user", "x"), (40, 0, "user", ""), (41, 0, "user", "")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_conversations_without_turns_end_at_the_root(spark):
    convs = spark.createDataFrame([(3, []), (1, []), (2, [(b"k" * 16, 4)])], "id long, turns array<struct<key:binary,words:long>>")
    got = {r.depth: r for r in prefix_trie.prefix_trie(convs).collect()}
    assert (got[0].n_convs, got[0].n_children, got[0].n_leaves, got[0].conv_id) == (3, 1, 1, 1)
    assert got[0].ends_sha256 == hashlib.sha256(b"1,3").hexdigest()
    assert (got[1].conv_id, got[1].parent_conv_id, got[1].saved_tokens) == (2, 1, 0)
    alone = prefix_trie.prefix_trie(convs.where("id <> 2")).collect()
    assert [(r.depth, r.n_leaves, r.n_convs) for r in alone] == [(0, 1, 2)]


def test_range_minima_search_both_ways():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 6, 77)
    table = prefix_trie.RangeMinima(values)
    at, bound = np.arange(77), rnd.integers(0, 7, 77)
    right, left = table.reach_right(at, bound), table.reach_left(at, bound)
    for i in range(77):
        r = i
        while r + 1 < 77 and values[r + 1] >= bound[i]:
            r += 1
        x = i
        while x > 0 and values[x] >= bound[i]:
            x -= 1
        assert (right[i], left[i]) == (r, x)
    assert (table.least(left, right + 1) == [values[a : b + 1].min() for a, b in zip(left, right, strict=True)]).all()
