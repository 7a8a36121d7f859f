"""SimHash near-dedup against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from mercata.llm import simhash as sh
from mercata.llm.common import min_labels


def slow_fingerprint(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows, max_bits=4):
    fps = np.array([slow_fingerprint(t) for _, t in rows], dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits)
    label = min_labels(len(rows), a, b)
    low = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted(((i, f"{f:016x}", low.get(c)) for (i, _), f, c in zip(rows, fps, label)), key=str)


def sample():
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = list(rng.choice(vocab, 200))
        for _ in range(8):
            w = list(base)
            for p in rng.integers(0, 200, rng.integers(0, 5)):
                w[p] = str(rng.choice(vocab))
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (7, "One"), (8, "ONE"), (9, "a b c"), (9, "a b c"), (None, "a b c"), (None, "lonely text here now")]
    rows += [(2000, "é x Ä " * 3), (2001, "long " * 200_000)]
    return rows


def test_components_match_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for blocks, limit in ((6, 4096), (5, 3)):
        got = sh.near_duplicates(df, blocks=blocks, limit=limit).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_index_finds_what_all_pairs_find():
    rng = np.random.default_rng(0)
    for _ in range(20):
        fps, starts, at = [], [], 0
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(1, 300))
            f = np.full(n, rng.integers(0, 2**63, dtype=np.uint64))
            for i in range(n):
                for bit in rng.integers(0, 64, rng.integers(0, 10)):
                    f[i] ^= np.uint64(1) << np.uint64(bit)
            rank = f.copy()
            for s in (1, 2, 4, 8, 16, 32):
                rank ^= rank >> np.uint64(s)
            fps.append(f[np.argsort(rank)])
            starts.append(at)
            at += n
        codes, group = np.concatenate(fps), np.repeat(np.arange(len(fps)), [len(f) for f in fps])
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
        a, b = np.nonzero(near & (group[:, None] == group[None, :]))
        assert (sh.link_groups(codes, np.array(starts), 4) == min_labels(len(codes), a, b)).all()


def test_nodes_hold_the_shared_bits():
    codes = np.array([0b1100, 0b1101, 0b1111], dtype=np.uint64)
    top = sh.build_index(codes, np.array([0]))[-1]
    assert top["pattern"].tolist() == [0b1100] and int(~top["mask"][0]) & 0xFFFFFFFFFFFFFFFF == 0b0011


def test_any_two_fingerprints_in_reach_agree_under_a_mask():
    rng = np.random.default_rng(1)
    for blocks in (5, 6, 7):
        ms = [np.uint64(m) for m in sh.masks(4, blocks)]
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(int(m) & diff == 0 for m in ms)
    with pytest.raises(ValueError):
        sh.masks(4, 4)


def test_empty_table_and_other_columns(spark):
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(2, "x", 1, "y"), (1, "x", 2, "z")], "doc_id long, text string, fp int, component_id string")
    assert {tuple(r)[::2] for r in sh.near_duplicates(df).collect()} == {(1, 1), (2, 1)}


def test_one_row_stays_per_component(spark):
    rows = [(i, f"text {i} of its own with words w{i} x{i} y{i} z{i}", "a") for i in range(3)]
    rows += [(None, f"no id {i} but words of its own v{i} u{i} t{i}", "a") for i in range(5)]
    rows += [(7, f"shared id {i} and words s{i} r{i} q{i}", "a") for i in range(3)]
    own = list(rows)
    # copies: a later id, none at all, the same row again, the same text with another column
    rows += [(50, rows[0][1], "b"), (None, rows[0][1], "b"), rows[1], rows[1], rows[3], (None, rows[3][1], "b"), (None, None, "a"), (9, "", "b"), (8, " ", "a")]
    schema = "doc_id long, text string, source string"
    kept = sorted(map(tuple, sh.one_per_component(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert len(brute([r[:2] for r in own])) == len({(c, f) for _, f, c in brute([r[:2] for r in own])}) == len(own)
    assert len(kept) == len(own) + 1
    assert {r[:2] for r in own} | {(8, " ")} == {r[:2] for r in kept}
    again = sh.one_per_component(spark.createDataFrame(rows[::-1], schema).repartition(5))
    assert sorted(map(tuple, again.collect()), key=str) == kept
    assert sh.one_per_component(spark.createDataFrame([], schema)).collect() == []


def test_one_per_component_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e", 5, "x", 9), (2, "a b c d e", 5, "y", 9), (3, "quite other words than those before", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, `a.b` string, id int")
    out = sh.one_per_component(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted((r.doc_id, r._row, r["a.b"], r.id) for r in out.collect()) == [(1, 5, "x", 9), (3, None, None, None)]
