"""Quality classifier: held-out accuracy, no leak of labels, edge cases."""

from __future__ import annotations

import zlib

import numpy as np

from mercata.llm import quality as ql
from mercata.llm.common import table


#: Large enough to have some seventy labelled rows held out.
LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, sf_dir=LARGER):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = ql.score_quality(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in truth if got[i].held_out]
    assert len(held) >= 50
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.95
    assert np.mean([got[i].predicted for i in held if truth[i] == 1]) >= 0.97


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    from pyspark.sql import functions as F

    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(apart, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    pick = lambda d, l: {r.doc_id: r.score for r in ql.score_quality(d, l, fit_rows=100).collect()}
    assert pick(docs, labels) == pick(other, flipped)


def test_vectors_learn_the_label():
    rng = np.random.default_rng(0)
    good, bad = ["apple", "pear", "plum"], ["###x", "$$$y", "%%%z"]
    sample = [({str(w): 1 for w in rng.choice(good if y else bad, 3)}, y) for y in rng.integers(0, 2, 200).tolist()]
    m = ql.train(sample)

    def score(*words):
        at, _ = ql.features(list(words), m.settings)
        return m.score(m.parts[at].sum(), len(at))

    assert score("apple", "plum") > 0.8 > 0.2 > score("$$$y", "###w")


def test_features_of_a_word_do_not_follow_its_company():
    cut = ql.Settings(grams=(2, 3, 5))
    words = ["a", "ab", "été", "longer-word", "x" * 50, "東京"]
    at, owner = ql.features(words, cut)
    for i, w in enumerate(words):
        alone, _ = ql.features([w], cut)
        assert sorted(at[owner == i]) == sorted(alone)
        assert len(alone) == ql.feature_count([w], cut)
    assert ql.feature_count(words * 2, cut) == 2 * len(at)
    assert [len(x) for x in ql.features([], cut)] == [0, 0]


def test_repeats_are_marked():
    assert ql.words_of("a a b a") == ["a", "a", "b", "a", ql.AGAIN] and ql.words_of(None) == []


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 5.0, "r"), (1, "good words here", 5.0, "r"), (2, None, 1.0, None), (3, "", 1.0, "r"), (None, " \n", 0.0, "r"), (4, "w" * 200_000, 0.0, "r")],
        "doc_id long, text string, score double, row string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    out = ql.score_quality(docs, labels)
    assert out.columns == ["doc_id", "text", "row", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = ql.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert ql.score_quality(docs.limit(0), labels).collect() == []


def test_labels_of_other_corpora_take_no_place(spark):
    """A hundred thousand labels, fifty documents: all that have a label and aren't held out teach."""
    words = {0: "### $$$ %%%", 1: "apple pear plum"}
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:50]
    docs = spark.createDataFrame([(i, f"{words[i % 2]} w{i % 3} {words[i % 2]}") for i in ids], "doc_id long, text string")
    labels = spark.range(100_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    sample = ql.labelled_sample(docs, labels, "doc_id", "text", "quality", 3000)
    assert len(sample) == 50
    got = {r.doc_id: r.score for r in ql.score_quality(docs, labels).collect()}
    assert min(s for i, s in got.items() if i % 2) > 0.5 > max(s for i, s in got.items() if not i % 2)
