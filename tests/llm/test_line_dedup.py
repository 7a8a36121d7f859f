"""Line dedup against a brute-force count of lines."""

from __future__ import annotations

from collections import Counter

from mercata.llm import line_dedup as ld

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, min_chars):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, lines in split for k in {key(x) for x in lines})
    out = []
    for i, lines in split:
        kept = [x for x in lines if not (len(key(x)) >= max(min_chars, 1) and seen[key(x)] >= min_docs)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_matches_brute_force(spark):
    rows = [(i, "\n".join(f"line {(i * 7 + j) % 23}" + " " * (j % 2) for j in range(i % 9)) + "\nÄ end\r") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " Shared \n\n\tSHARED"), (None, "line 3"), (None, None), (5, "line 3"), (5, "line 3")]
    rows += [(103 + i, "shared\nown %d" % i) for i in range(4)] + [(200, "x\n" * 5000 + "y" * 100_000)]
    for min_docs, min_chars, batches in ((2, 1, 3), (5, 1, 1), (10, 1, 4), (3, 7, 2)):
        got = rows_of(ld.dedup_lines(docs(spark, rows), min_docs=min_docs, min_chars=min_chars, batches=batches))
        assert got == brute(rows, min_docs, min_chars)


def test_a_line_in_nearly_all_documents_and_the_joined_rest(spark, monkeypatch):
    rows = [(i, f"top\nrare {i // 2}\nmid {i % 50}") for i in range(400)]
    monkeypatch.setattr(ld, "HEAVY_PART", 4)  # only "top" is told to the tasks
    assert rows_of(ld.dedup_lines(docs(spark, rows), min_docs=2)) == brute(rows, 2, 1)


def test_empty_table_and_other_columns(spark):
    assert ld.dedup_lines(docs(spark, [])).collect() == []
    df = spark.createDataFrame(
        [(1, "a", "b", "a\nc", 9, None, [1]), (2, None, None, "a", 9, "x", None)],
        "doc_id long, key string, id string, text string, n_lines int, row string, keys array<int>",
    )
    out = ld.dedup_lines(df, min_docs=2)
    assert out.columns == ["doc_id", "key", "id", "text", "row", "keys", "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].text, got[1].n_lines, got[1].n_dropped, got[1].key, got[1]["keys"]) == ("c", 2, 1, "a", [1])
    assert (got[2].text, got[2].n_dropped, got[2].row) == ("", 1, "x")


def test_runs_are_compacted_and_saturated_lines_are_not_added_again(spark):
    runs = ld.LineRuns(spark, min_docs=3, fanout=2)
    batch = lambda *kv: spark.createDataFrame([(bytearray(k), n) for k, n in kv], "key binary, n long")
    runs.add(batch((b"a", 3), (b"b", 1)))
    runs.add(batch((b"a", 5), (b"b", 1)))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert {bytes(r.key): r.n for r in runs.totals().collect()} == {b"a": 3, b"b": 2}
    runs.add(batch((b"b", 1)))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted(bytes(r.key) for r in runs.frequent().collect()) == [b"a", b"b"]


def test_heavy_lines_are_counted_over_all_batches(spark, monkeypatch):
    """The runs stop counting a saturated line; a line in half of all pairs is told to the tasks all the same."""
    rows = [(i, f"everywhere\nrare {i // 3}") for i in range(300)]
    told = []
    rewriter = ld._rewriter
    monkeypatch.setattr(ld, "HEAVY_PART", 4)
    monkeypatch.setattr(ld, "_rewriter", lambda chars, heavy: told.append(heavy) or rewriter(chars, heavy))
    assert rows_of(ld.dedup_lines(docs(spark, rows), min_docs=2, batches=5)) == brute(rows, 2, 1)
    assert [len(h) for h in told] == [1]


def test_documents_without_an_id_are_rows_of_their_own(spark):
    """A third of all rows has no id, some share one; each loses its own lines, and copies theirs."""
    rows = [(None if i % 3 == 0 else i % 7, f"shared {i % 4}\nown {i}\nfew {i // 2}") for i in range(120)] + [(None, "own 0")] * 3
    assert rows_of(ld.dedup_lines(docs(spark, rows), min_docs=4)) == brute(rows, 4, 1)
