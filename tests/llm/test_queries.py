"""Registered queries equal their SQL, and the pipeline equals its stages by brute force."""

from __future__ import annotations

import importlib.util
import os
import sys

import numpy as np
import pytest

from mercata.llm.oracle import SQL
from mercata.llm.queries import QUERIES
from mercata.llm import quality
from mercata.llm.common import table

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_decontaminate import brute as leaks  # noqa: E402
from test_line_dedup import brute as lines  # noqa: E402
from test_packing import check as packed  # noqa: E402
from test_simhash import brute as copies  # noqa: E402


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, duck_con, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck_con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(columns, want.fetchall())


def test_all_are_registered():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = sorted(map(tuple, QUERIES["op3_simhash_dedup"](spark, sf_dir).collect()), key=str)
    assert got == copies(docs)


def test_pack_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    packed(docs, QUERIES["op10_pack"](spark, sf_dir).collect())


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, table(spark, sf_dir, "labels")).collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] >= 0.3]
    kept = [(i, t) for i, t, _, _ in lines(kept, 10, 1)]
    heads = {i for i, _, c in copies(kept) if i == c}
    kept = [(i, t) for i, t in kept if i in heads]
    clean = {r[0] for r in leaks(kept, items, 10) if r[2] == 0}
    kept = [(i, t) for i, t in kept if i in clean]
    assert 0 < len(kept) < docs.count()
    packed(kept, corpus_pipeline.run(spark, sf_dir).collect())


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_stages_keep_the_columns_and_bear_odd_rows(spark, sf_dir):
    import corpus_pipeline

    real = table(spark, sf_dir, "documents")
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing",
    ]
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "no id at all", "en", "s", 12), (3, "w " * 100_000, "en", "s", 200_000)]
    for rows in (odd, []):
        df = spark.createDataFrame(rows, real.schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.columns == real.columns and out.dtypes == real.dtypes
            out.collect()
        assert len(corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect()) >= len(rows)
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(odd, real.schema), sf_dir).collect()
    assert np.unique([str(r.doc_id) for r in kept]).size == len(kept)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_near_duplicate_stage_keeps_documents_that_share_an_id(spark, sf_dir):
    import corpus_pipeline

    own = [(None, f"no id {i} but words of its own v{i} u{i} t{i}") for i in range(5)] + [(7, f"shared id {i} and words s{i} r{i} q{i}") for i in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in own + own[:1] + [(None, own[6][1])]]
    df = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    kept = corpus_pipeline.near_duplicate_stage(spark, df, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(own, key=str)
