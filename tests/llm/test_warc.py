"""WARC round trips, and salvage of damaged archives."""

from __future__ import annotations

import base64
import gzip
import hashlib

import numpy as np
import pytest

from mercata.llm import warc
from mercata.llm.common import shared_folder


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(rows, min_bytes):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[digest(t)] = min(first.get(digest(t), i), i)
    out = []
    for i, _, t in rows:
        n, head = len((t or "").encode()), first.get(digest(t))
        again = n >= min_bytes and head is not None and i != head
        out.append((i, n, digest(t), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/", "<p>x</p>"), (3, "http://b/?q=\r\nWARC/1.1", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "u", None), (2, "u", ""),
    (4, "u", "ä" * 50_000), (3, "http://b/", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, "u", "only here"),
    (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "a\r\n\r\nb"),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, payload string, sha int")
    got = warc.round_trip(df, min_bytes).select("page_id", "payload_bytes", "payload_digest", "type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, min_bytes)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_payloads_come_back_and_archives_are_cut(spark):
    folder = shared_folder(spark, "warc-test")
    rows = [(i, f"http://h/{i}", "".join(chr(97 + (i * k) % 26) for k in range(3000))) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, folder, most_bytes=2000)
    assert manifest.count() > 5 and {r.records for r in manifest.collect()} != {0}
    back = warc.read_archives(spark, folder, manifest).collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in back if r.type == "response"} <= set(rows)
    assert sorted(r.page_id for r in back) == list(range(1, 40))
    assert warc.read_gaps(spark, folder).collect() == []


def records(n=12):
    return [warc.record(i, f"http://h/{i}", bytes([65 + i]) * (40 + i), None, False) for i in range(n)]


def test_salvage_of_an_untouched_archive():
    for data in (b"".join(map(warc.member, records())), b"".join(records())):
        out = warc.salvage(data)
        assert [int(r.headers["x-page-id"]) for r in out.records] == list(range(12)) and out.gaps == []
    assert warc.salvage(b"").records == [] and gzip.decompress(warc.member(records()[0])) == records()[0]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_all_records_that_damage_left_whole(packed):
    rng = np.random.default_rng(8)
    parts = [warc.member(r) if packed else r for r in records()]
    ends = np.cumsum([len(p) for p in parts])
    for _ in range(60):
        data = bytearray(b"".join(parts))
        hit = set()
        for at in rng.integers(0, len(data), rng.integers(1, 4)).tolist():
            data[at] ^= 0xFF
            hit.add(int(np.searchsorted(ends, at, side="right")))
        out = warc.salvage(bytes(data))
        found = [(r.headers, r.payload) for r in out.records]
        for i in set(range(12)) - hit:
            whole = warc.salvage(parts[i]).records[0]
            assert (whole.headers, whole.payload) in found
        # no byte of a whole record is in a gap, and no damaged payload passes as whole
        covered = sum(g.end - g.start for g in out.gaps)
        assert covered <= sum(len(parts[i]) for i in hit)
        assert all(len(set(payload)) == 1 and 40 <= len(payload) <= 51 for _, payload in found)


def test_gaps_are_logged_with_their_reason():
    parts = [warc.member(r) for r in records(4)]
    data = parts[0] + b"junk" + parts[1] + parts[2][:-3] + parts[3]
    out = warc.salvage(data)
    assert [int(r.headers["x-page-id"]) for r in out.records] == [0, 1, 3]
    a, b = len(parts[0]), len(parts[0]) + 4 + len(parts[1])
    assert [(g.start, g.end) for g in out.gaps] == [(a, a + 4), (b, b + len(parts[2]) - 3)]
    assert out.gaps[0].reason == "no version line" and out.gaps[1].reason.startswith("gzip")


def test_a_cut_archive_and_a_wrong_digest():
    parts = records(3)
    cut = warc.salvage(b"".join(map(warc.member, parts))[:-5])
    assert len(cut.records) == 2 and len(cut.gaps) == 1
    swapped = parts[1].replace(b"B" * 41, b"C" * 41)
    out = warc.salvage(parts[0] + swapped + parts[2])
    assert len(out.records) == 2 and out.gaps[0].reason == "block digest"


def test_members_of_several_records():
    """An archive compressed as a whole, or in groups, gives all its records; what is damaged inside is told."""
    raw = records(6)
    out = warc.salvage(warc.member(b"".join(raw[:4])) + warc.member(b"".join(raw[4:])))
    assert [int(r.headers["x-page-id"]) for r in out.records] == list(range(6)) and out.gaps == []
    bad = raw[1].replace(b"B" * 41, b"C" * 41)
    whole = warc.member(raw[0] + bad + raw[2])
    out = warc.salvage(whole + warc.member(raw[3]))
    assert [int(r.headers["x-page-id"]) for r in out.records] == [0, 2, 3]
    assert [(g.start, g.end, g.reason) for g in out.gaps] == [(0, len(whole), "inside the member: block digest")]
    assert warc.salvage(warc.member(b"no record")).gaps[0].reason == "no version line"


def test_time_grows_with_the_damage():
    """Twice the damaged bytes take about twice the time, whatever they hold."""
    import time

    kinds = (b"WARC/1.1\r\n", b"WARC/1.1\r\na: b\r\n", b"\x1f\x8b\x08", b"WARC/1.0\r\n\r\n", b"\x1f\x8b\x08\x00WARC/1.")
    for kind in kinds:
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            out = warc.salvage(kind * n + records(1)[0])
            took.append(time.process_time() - began)
            assert len(out.records) == 1 and len(out.gaps) == 1
        assert took[1] < 10 * max(took[0], 0.05), kind


def test_a_quoted_record_of_a_damaged_one_is_recovered():
    inner = warc.record(9, "http://h/9", b"quoted", None, False)
    outer = warc.record(1, "http://h/1", b"x" * 50 + inner + b"y" * 50, None, False)
    assert [int(r.headers["x-page-id"]) for r in warc.salvage(outer).records] == [1]
    damaged = outer.replace(b"x" * 50, b"z" * 50)
    assert [int(r.headers["x-page-id"]) for r in warc.salvage(damaged).records] == [9]
