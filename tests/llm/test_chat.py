"""Preference formatting against plain Python."""

from __future__ import annotations

from mercata.llm import chat

SCHEMA = "pair_id long, turn long, role string, text string"


def brute(chosen, rejected):
    def side(rows):
        out = {}
        for k, t, r, x in rows:
            out.setdefault(k, []).append(((t is not None, t), r or "", x or ""))
        return {k: [(r, x) for _, r, x in sorted(v)] for k, v in out.items()}

    def draw(turns):
        return "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in turns)

    def spans(turns):
        at, out = 0, []
        for r, x in turns:
            begin, end = at + len("<|im_start|>") + len(r) + 1, at + len(draw([(r, x)]))
            if r == "assistant":
                out.append((begin, end))
            at = end
        return out

    a, b = side(chosen), side(rejected)
    want = []
    for k in a.keys() & b.keys():
        n = 0
        while n < min(len(a[k]), len(b[k])) and a[k][n] == b[k][n]:
            n += 1
        x, y = a[k][n:], b[k][n:]
        want.append((k, n, draw(a[k][:n]), draw(x), draw(y), spans(x), spans(y), not x and not y))
    return sorted(want, key=str)


def rows_of(df):
    fix = lambda s: [tuple(x) for x in s]
    return sorted(((*tuple(r)[:5], fix(r.chosen_spans), fix(r.rejected_spans), r.same) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    chosen = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi ä"), (1, 2, "assistant", "ünder"), (1, 3, "user", "more"), (1, 4, "assistant", "x"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 1, None, None), (3, 0, "user", ""), (4, 0, "user", "alone"),
        (5, 0, "assistant", "tie b"), (5, 0, "assistant", "tie a"), (5, 0, "assistant", "tie a"), (5, None, "user", "null turn"),
        (None, 0, "user", "q"), (None, 1, "assistant", "a1"), (6, 0, "user", "long " * 50_000),
    ]
    rejected = [
        (1, 1, "user", "hi ä"), (1, 0, "system", "be kind"), (1, 2, "assistant", "other"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", ""), (3, 1, "assistant", "z"),
        (5, 0, "assistant", "tie a"), (5, None, "user", "null turn"), (None, 0, "user", "q"), (None, 1, "assistant", "a2"), (7, 0, "user", "alone"),
        (6, 0, "user", "long " * 50_000), (6, 1, "assistant", "b"),
    ]
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (chosen, rejected))
    out = chat.format_pairs(a, b)
    assert rows_of(out) == brute(chosen, rejected)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_swapped_answers(spark):
    turns = [
        (0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "first"), (1, 2, "assistant", "a1"),
        (2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (3, 0, "user", "no answer"), (None, 0, "assistant", "kept"),
    ]
    got = chat.swapped_answers(spark.createDataFrame(turns, SCHEMA), key="pair_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(0, 0, "user", "q0"), (0, 1, "assistant", "a1"), (1, 0, "user", "q1"), (1, 1, "assistant", "first"), (1, 2, "assistant", "a0"),
         (2, 0, "user", "q2"), (3, 0, "user", "no answer"), (None, 0, "assistant", "kept")], key=str,
    )


def test_empty_tables_and_other_columns(spark):
    a = spark.createDataFrame([(1, 0, "user", "x", 5, "y")], SCHEMA + ", n int, a string")
    assert chat.format_pairs(a, a).first().same
    assert chat.format_pairs(a, a.limit(0)).collect() == [] and chat.swapped_answers(a.limit(0), key="pair_id").collect() == []


def test_query_keeps_a_conversation_without_a_rejected_side(spark, tmp_path):
    from hashlib import sha256

    from mercata.llm.queries import op8_preference_pairs

    turns = [(0, 0, "assistant", "alone"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "assistant", "b"), (None, 0, "assistant", "n")]
    spark.createDataFrame(turns, SCHEMA.replace("pair_id", "conv_id")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op8_preference_pairs(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 2, 3, None}
    drawn = "<|im_start|>assistant\nalone<|im_end|>\n"
    digest = lambda t: sha256(t.encode()).hexdigest()
    r = got[0]
    assert (r.n_prompt, r.chosen_sha256, r.rejected_sha256) == (0, digest(drawn), digest(""))
    assert (r.chosen_spans, r.rejected_spans, r.same) == (f"22-{len(drawn)}", "", False)


def test_sql_keeps_conversations_without_a_rejected_side(spark, tmp_path):
    """A lone answer whose neighbour has none is left out of the rejected side; the pair stays, in SQL too."""
    import duckdb

    from mercata.llm.oracle import SQL
    from mercata.llm.queries import QUERIES

    rows = [(0, 0, "assistant", "alone"), (1, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "r"), (3, 1, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = QUERIES["op8_preference_pairs"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(SQL["op8_preference_pairs"])
    names = [c[0] for c in want.description]
    got = sorted(tuple(r[c] for c in names) for r in out.collect())
    assert got == sorted(want.fetchall()) and [r[names.index("conv_id")] for r in got] == [0, 1, 2, 3]
