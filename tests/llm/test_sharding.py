"""Histogram sort: exact splitters, near-equal bytes, gapless slots."""

from __future__ import annotations

import zlib

import numpy as np

from mercata.llm import sharding


def check(rows, got, shards, tolerance=0.001):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, size(t)) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    total = sum(size(t) for _, t in rows)
    largest = max(size(t) for _, t in rows)
    for s in range(shards):
        own = by.get(s, [])
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= 2 * largest + 2 * total / shards * tolerance + 1


def test_sizes_are_near_equal(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 400, 900))] + [(i, "y" + "z" * i) for i in range(1000, 1200)]
    rows += [(2000, None), (2001, ""), (2002, "ä" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for shards in (1, 4, 16):
        check(rows, sharding.shard_by_bytes(df, shards=shards).collect(), shards)


def test_a_group_of_copies_larger_than_a_shard_is_cut_by_id_and_no_other_is(spark):
    rows = [(i, "same text of a third of all rows" if i % 3 == 0 else f"text {i // 2 * 2} of a pair of copies .....") for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=16).collect()
    check(rows, got, 16)
    text, of = dict(rows), {}
    for r in got:
        of.setdefault(text[r.doc_id], set()).add(r["shard"])
    assert len(of["same text of a third of all rows"]) >= 5
    assert sum(len(s) > 1 for t, s in of.items() if t != "same text of a third of all rows") <= 15


def test_repeated_rows_nulls_other_columns_and_empty_tables(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (None, "a"), (None, None), (2, None)] * 30
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, high string, slot int")
    out = sharding.shard_by_bytes(df, shards=3)
    assert out.columns == ["doc_id", "text", "high", "size", "shard", "slot"]
    got = out.collect()
    assert len(got) == 180 and len({(r["shard"], r.slot) for r in got}) == 180
    assert sharding.shard_by_bytes(df.limit(0), shards=3).collect() == []


def test_documents_are_placed_without_python(spark, monkeypatch):
    """Only keys pass through Python; whole documents there fill an executor's memory beside its heap."""
    DataFrame = type(spark.range(1))
    seen, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **b: seen.append(self.columns) or plain(self, *a, **b))
    rows = [(i, f"text {i % 50}") for i in range(400)]
    check(rows, sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect(), 4)
    assert seen and all(set(columns) <= {"high", "low", "size"} for columns in seen)


def test_a_document_larger_than_all_others(spark):
    for big in (1, 2):
        rows = [(i, "x" * (1000 if i == big else 0)) for i in (1, 2)]
        for shards in (3, 16):
            got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect()
            assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(t) + 1) for i, t in rows)
            assert all(0 <= r["shard"] < shards for r in got) and len({(r["shard"], r.slot) for r in got}) == 2


def test_splitters_count_exactly(spark):
    rng = np.random.default_rng(1)
    high = rng.integers(-(2**63), 2**63, 500)
    rows = [(int(h), i, int(s)) for i, (h, s) in enumerate(zip(high, rng.integers(1, 50, 500)))]
    cuts, rounds = sharding.splitters(spark.createDataFrame(rows, "high long, low long, size long"), 8)
    total, keys = sum(r[2] for r in rows), [((h + 2**63) << 64) + low + 2**63 for h, low, _ in rows]
    below = [sum(r[2] for k, r in zip(keys, rows) if k < c) for c in cuts]
    assert all(abs(n - total * (i + 1) // 8) <= 50 for i, n in enumerate(below)) and rounds <= 4


def test_crc_of_the_query(spark, sf_dir):
    from mercata.llm.common import table
    from mercata.llm.queries import QUERIES

    text = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op7_shard"](spark, sf_dir).collect()
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    check(list(text.items()), got, 16)


def test_the_query_puts_whole_documents_into_shards(spark, tmp_path, monkeypatch):
    from mercata.llm.queries import QUERIES

    rows = [(i, f"text {i % 7} " * (i % 5), "en", "web") for i in range(60)] + [(60, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found, plain = [], sharding.shard_by_bytes
    monkeypatch.setattr(sharding, "shard_by_bytes", lambda *a, **b: found.append(plain(*a, **b)) or found[-1])
    got = {r.doc_id: r for r in QUERIES["op7_shard"](spark, str(tmp_path)).collect()}
    assert {(r.doc_id, r.text, r.lang, r.source, r.shard, r.slot) for r in found[0].collect()} == {
        (*r, got[r[0]]["shard"], got[r[0]].slot) for r in rows
    }
    assert all(got[i].text_crc32 == zlib.crc32((t or "").encode()) and got[i].size == len(t or "") + 1 for i, t, *_ in rows)
