"""Target alignment against an automaton of the grammar, and the faults against plain Python."""

from __future__ import annotations

import random
import re
import zlib

from mercata.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("z", 0): "s", ("z", 1): "u", ("s", 1): "u", ("a", 1): "u", ("u", 2): "a"}


def least(codes):
    """Least (cost, audit), state by state of the automaton, every edit tried."""
    now = {"z": (0, "")}

    def put(states, state, value):
        states[state] = min(states.get(state, value), value)

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                for letter in (1, 2):
                    if (state, letter) in NEXT:
                        put(states, NEXT[state, letter], (cost + 3, audit + "I"))
        return states

    for code in codes:
        then = {}
        for state, (cost, audit) in inserted(dict(now)).items():
            put(then, state, (cost + 4, audit + "D"))
            extra = 3 if code & 1 else 0
            for letter in () if code & 2 else (0, 1, 2):
                if (state, letter) in NEXT:
                    if letter == code >> 2:
                        put(then, NEXT[state, letter], (cost + extra, audit + "K"))
                    if letter:
                        put(then, NEXT[state, letter], (cost + extra + 3, audit + "R"))
        now = then
    return min(v for state, v in inserted(now).items() if state in "za")


def test_alignment_is_the_cheapest_and_the_ascii_least():
    rnd = random.Random(5)
    for n in range(3000):
        size = rnd.randint(0, 9) if n % 40 else rnd.randint(30, 60)
        codes = bytes(4 * rnd.choice([0, 1, 1, 1, 2, 2, 2, 3]) + rnd.choice([0, 0, 0, 0, 1, 2]) for _ in range(size))
        assert repair.align(codes) == least(codes), list(codes)


def test_a_long_conversation_stays_inside_its_band():
    sound = bytes([0, *[4, 8] * 2000])
    assert repair.align(sound) == (0, "K" * 4001)
    assert repair.Alignment(sound).plain.shape[1] == 2
    broken = sound[:1000] + sound[1001:]
    assert repair.align(broken) == least(broken)


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        kept = []
        for _, t, r, x in (r for r in rows if r[0] == c):
            r, x = " " if r is None else r, " " if x is None else x
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if fault == 0:
                continue
            x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
            kept += [((t is not None, t or 0), "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
        kept.sort()
        codes, seen, n = [], set(), dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        for j, (_, r, x) in enumerate(kept):
            fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", x) else "duplicate" if (r, x) in seen else ""
            fault = fault or ("" if re.findall(r"[^\x20\x09-\x0D]", x)[-1] in ".!?" else "truncated")
            seen.add((r, x))
            if fault:
                n[fault] += 1
            codes.append(4 * {"s": 0, "u": 1, "a": 2}.get(r[:1], 3) + (1 if fault == "truncated" else 2 if fault else 0))
            n["illegal"] += j > 0 and kept[j - 1][1][:1] + r[:1] not in ("su", "ua", "au")
        cost, audit = least(bytes(codes))
        turns = [t[1] for t, _, _ in kept if t[0]]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), cost, audit)
    return out


def test_conversations_match_plain_python(spark):
    rnd = random.Random(2)
    texts = ["Yes.", "No!", "cut", " ", "", None, "Why?  ", "long " * 50_000 + ".", "a.\x0b", "\x85"]
    rows = []
    for c in [*range(-3, 80), None]:
        for t in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([t, t, t, t, None, 3]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rnd.choice(texts)))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS gone", "1 AS id", "2 AS _times")
    got = repair.repair(repair.damage(df)).collect()
    assert len(got) == 84
    want = brute(rows)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[r.id], r.id
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in r.repaired))
        assert len(r.repaired) == len(r.audit.replace("D", ""))


def test_edits_make_the_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "tool", "Hello."), (1, 2, "assistant", "More."), (1, 3, "assistant", " "), (2, 0, "system", "S."), (2, 1, "user", "cut")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id AS id", "turn", "role", "text", "false AS gone")
    got = {r.id: r for r in repair.repair(df).collect()}
    assert (got[1].audit, got[1].cost) == ("KDKD", 8)
    assert [(x.role, x.text) for x in got[1].repaired] == [("user", "Hi."), ("assistant", "More.")]
    assert (got[2].audit, got[2].cost) == ("KKI", 6)
    assert [(x.role, x.text) for x in got[2].repaired] == [("system", "S."), ("user", "cut"), ("assistant", "")]
    assert repair.repair(df.limit(0)).collect() == []


def test_a_conversation_that_lost_all_rows_is_still_told(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair(repair.damage(spark.createDataFrame([(c, 0, "user", "Gone.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(c, 0, 0, 0, 0, 0, 0, "", [])]
