"""Packing: every id in one piece, full windows, exact ids."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mercata.llm import packing
from mercata.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def check(texts, got, tiers=packing.TIERS):
    """``texts``: (id, text) with unique ids."""
    ids = {i: plain(t) + [2] for i, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].window <= tiers[-1] and at & (at - 1) == 0
        assert len({r.window for r in own}) == len({r.step for r in own}) == 1
    return sequences


def test_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = packing.pack(docs, PATH).collect()
    sequences = check([(r.doc_id, r.text) for r in docs.collect()], got)
    steps = defaultdict(list)
    for own in sequences.values():
        steps[own[0].step].append(own[0].window)
    assert all(len(set(w)) == 1 and sum(w) <= 32 * 1024 for w in steps.values())
    whole = sum(len([r for r in got if r.doc_id == i]) == 1 for i in {r.doc_id for r in got if r.doc_tokens <= 4096})
    assert whole >= 0.8 * len({r.doc_id for r in got if r.doc_tokens <= 4096})


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "word " * 30_000), (6, "x" * 20_000), (7, "<|endoftext|> in text"), (8, "a\x1cb \x85 c")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, length int, id string").repartition(3)
    check(rows, packing.pack(df, PATH, held_tokens=64).collect())
    assert packing.pack(df.limit(0), PATH).collect() == []
    twice = spark.createDataFrame([(9, "same row"), (9, "same row"), (None, "no id")], "doc_id long, text string")
    got = packing.pack(twice, PATH).collect()
    assert sum(r.length for r in got) == 3 * 3 and sum(r.length for r in got if r.doc_id is None) == 3


@pytest.mark.parametrize("text", ["Don't stop... it's 4.0, ok?", "e.g. A.B.C. x,y, z., (q).", "ÉÀ é. İstanbul ΣΑΣ ς", "東京, ok. हिन्दी ", "a b c​d é. n.́ '."])
def test_chunks_give_the_ids_of_the_whole_text(text):
    got = packing.ChunkTokenizer(PATH).encode([text, None, text * 3])
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [plain(text), [], plain(text * 3)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text(alphabet="aB.,'! \n\té0-Σ\x1f", max_size=30))
def test_chunks_give_the_ids_of_any_text(text):
    got = packing.ChunkTokenizer(PATH).encode([text])[0]
    assert np.frombuffer(got, "<u2").tolist() == plain(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_packer_fills_every_window(lengths):
    tiers = (8, 16, 32, 64)
    packer, out = packing.Packer(tiers), []
    for i, n in enumerate(lengths):
        out += packer.add(i, n)
        if i % 7 == 6:
            out += list(packer.windows(False))
    out += list(packer.windows(True))
    seen = defaultdict(set)
    for window, pieces in out:
        assert sum(p.length for p in pieces) == window and window & (window - 1) == 0 and window <= 64
        for p in pieces:
            own = set(range(p.start, p.start + p.length))
            assert not seen[p.doc] & own
            seen[p.doc] |= own
    assert {i: len(seen[i]) for i in seen} == dict(enumerate(lengths))


def test_steps_hold_equal_tokens_of_like_cost():
    one = lambda n, *lengths: (n, [packing.Piece(x, 0, 0) for x in lengths])
    windows = [one(8, 8), one(8, 4, 4), one(8, 8), one(8, 2, 2, 2, 2), one(4, 4), one(4, 1, 3)]
    assert packing.steps_of(windows, 16) == [0, 1, 0, 1, 2, 2]


def test_short_windows_do_not_grow_with_the_partitions(spark, sf_dir):
    """However the documents are dealt, only the last ids of all partitions together end in short windows."""
    docs = table(spark, sf_dir, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    short = []
    for parts in (1, 32):
        sequences = check(texts, packing.pack(docs.repartition(parts), PATH).collect())
        short.append(sum(own[0].window < packing.TIERS[0] for own in sequences.values()))
    assert max(short) <= 8


def test_a_partition_with_little_and_one_with_nothing(spark):
    rows = [(i, "a few words of text " * (i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)
    check(rows, packing.pack(df, PATH).collect())
