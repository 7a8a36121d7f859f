"""p-stable hashing against all cosines."""

from __future__ import annotations

import numpy as np

from mercata.llm import embedding_lsh as el
from mercata.llm.common import min_labels, table


def brute(ids, vectors, cosine):
    ok = np.array([v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors])
    n = len(ids)
    near = np.zeros((n, n), bool)
    at = np.flatnonzero(ok)
    unit = np.array([np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in at])
    near[np.ix_(at, at)] = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    label = min_labels(n, a, b)
    low = {}
    for i, c in zip(ids, label):
        low[c] = min(low.get(c, i), i)
    return near, {(i, int(near[k].sum()), low[label[k]], i == low[label[k]]) for k, i in enumerate(ids)}


def test_recall_on_the_given_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    rows = df.collect()
    near, want = brute([r.vec_id for r in rows], [r.embedding for r in rows], 0.95)
    got = el.near_duplicates(df).collect()
    assert sum(r.n_links for r in got) >= 0.9 * near.sum()
    exact = {r[0]: r for r in want}
    assert all(r.n_links <= exact[r.vec_id][1] for r in got)


def test_recall_at_the_threshold_itself(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((300, 64))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    pair = 0.9501 * base + np.sqrt(1 - 0.9501**2) * off
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, pair * 3.0]))]
    got = el.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 600


def test_copies_scaled_copies_and_unusable_vectors(spark):
    v, w = [1.0, 2.0, 0.0], [0.0, 0.0, 5.0]
    nan, inf = float("nan"), float("inf")
    vectors = [v, v, [2.0, 4.0, 0.0], w, None, [], [0.0, 0.0, 0.0], [nan, 1.0, 1.0], [inf, 0.0, 1.0], [None, 1.0, 2.0], [1.0, 2.0], v, [-0.0, 0.0, 5.0]]
    ids = [5, 3, 9, 1, 2, 4, 6, 7, 8, 10, 11, 3, 12]
    df = spark.createDataFrame(list(zip(ids, vectors, [0] * 13, ["x"] * 13)), "vec_id long, embedding array<double>, label int, weight string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in el.near_duplicates(df).collect())
    linked = [(3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False), (9, 3, 3, False), (1, 1, 1, True), (12, 1, 1, False)]
    alone = [(i, 0, i, True) for i in (2, 4, 6, 7, 8, 10, 11)]
    assert got == sorted(linked + alone)
    assert el.near_duplicates(df.limit(0)).collect() == []


def test_a_large_bucket_is_compared_block_by_block(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    vectors = [(base + 0.05 * rng.standard_normal(16)).tolist() for _ in range(120)] + rng.standard_normal((30, 16)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    _, want = brute(list(range(150)), vectors, 0.95)
    got = {tuple(r) for r in el.near_duplicates(df, limit=16, hashes=2).collect()}
    assert got == want


def test_a_pair_that_meets_in_many_families_counts_once(spark):
    """Few hashes and small blocks: near copies share many buckets, blocks and families."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((4, 24))
    vectors = [(centres[i % 4] + 0.08 * rng.standard_normal(24)).tolist() for i in range(160)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    exact = [r.embedding for r in df.collect()]
    _, want = brute(list(range(160)), exact, 0.95)
    got = {tuple(r) for r in el.near_duplicates(df, limit=8, hashes=1, tables=6).collect()}
    assert got == want


def test_sketches_keep_what_is_near():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((2000, 64))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = 0.95 * base + np.sqrt(1 - 0.95**2) * off
    a, b = el.sketches(base, 7), el.sketches(near, 7)
    bits = np.bitwise_count(a ^ b).sum(axis=1)
    assert bits.max() <= el.most_signs(0.95) < 40
    assert np.bitwise_count(a[:-1] ^ a[1:]).sum(axis=1).min() > el.most_signs(0.95)
