"""Decontamination against a brute-force search for windows."""

from __future__ import annotations

import re

import numpy as np
import pytest

from mercata.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window):
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, w[k : k + window]) for k in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, win in wins:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=str)


def sample():
    rng = np.random.default_rng(4)
    vocab = ["The", "of", "é", "Ünder", "x1", "alpha", "beta", "gamma", "delta", "omega"]
    text = lambda n: " ".join(rng.choice(vocab, n)) + "."
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 14, 25))]
    items += [(30, None), (31, ""), (32, "..."), (33, "ha ha ha ha ha ha ha"), (34, "ha ha ha ha ha ha ha"), (None, "lone item words")]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 120, 40))]
    docs += [(100 + i, f"{text(9)}, {items[i % 25][1].upper()} -- {text(5)}") for i in range(25)]
    docs += [(200, None), (201, ""), (202, "ha " * 40), (203, "one LONE item words here"), (203, "one LONE item words here"), (None, "ha" * 3)]
    return docs, items


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_matches_brute_force_in_one_block_and_in_many(spark, block_words):
    docs, items = sample()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (1, 4, 10):
        got = dc.find_contamination(d, b, window=window, block_words=block_words)
        assert found(got) == brute(docs, items, window)
        for r in got.collect():
            assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_hit


def test_prefix_is_the_rarest_shingle(spark):
    block = dc.make_block({(b"a", b"b", b"c", b"d"): [1]})
    codes = dc.window_shingles(block, 2)[4][0]
    dc.choose_prefixes(block, 2, {2: {int(codes[0]): 9, int(codes[1]): 1, int(codes[2]): 5}})
    assert block.prefixes[4][1].tolist() == [1]


def test_empty_tables_and_other_columns(spark):
    d = spark.createDataFrame([(1, "a b", 7, "z")], "doc_id long, text string, n_hit int, row string")
    none = spark.createDataFrame([], "item_id long, text string")
    out = dc.find_contamination(d, none)
    assert out.columns == ["doc_id", "text", "row", "n_words", "n_hit", "items", "spans"]
    assert tuple(out.first()) == (1, "a b", "z", 2, 0, [], [])
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.find_contamination(d.limit(0), item).collect() == []
    assert dc.find_contamination(d, item).first()["items"] == [1]


def test_a_very_long_text(spark):
    text = "w " * 300_000 + "p q r s t u v w x y " + "w " * 300_000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    item = spark.createDataFrame([(5, "p q r s t u v w x y")], "item_id long, text string")
    r = dc.find_contamination(d, item).first()
    assert (r.n_words, r.n_hit, r["items"], r.spans) == (600_010, 10, [5], [300_000, 300_010])
