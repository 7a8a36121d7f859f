from __future__ import annotations

import numpy as np

from mercata.llm.common import min_labels, split_hot_groups
from mercata.llm.components import components


def test_chains_stars_and_nulls(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (4, None)]
    links += [(int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2))]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = np.array([x for x in links if None not in x])
    label = min_labels(400, pairs[:, 0], pairs[:, 1])
    assert got == {i: int(c) for i, c in enumerate(label) if c != i}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_each_pair_of_a_large_group_meets_once(spark):
    keyed = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(5)], "k int, m long")
    rows = split_hot_groups(keyed, ["k"], "m", 10).collect()
    met = {}
    for a in rows:
        for b in rows:
            if a.k == b.k and (a.block_a, a.block_b) == (b.block_a, b.block_b) and a.m < b.m:
                if a.block_a == a.block_b or a.block != b.block:
                    met[a.k, a.m, b.m] = met.get((a.k, a.m, b.m), 0) + 1
    assert len(met) == 50 * 49 // 2 + 10 and set(met.values()) == {1}
