"""Conversation structure repair by Wagner-Fischer target alignment.

A sound conversation is an optional system turn and pairs of user and
assistant turns: ``(s?(ua)+)?`` over role initials, the empty one included.
For each feasible length there is one target without and one with a system
turn. Turns are aligned to each target at least cost by the Wagner-Fischer
recurrence, in a band that the incumbent cost (of a plain left-to-right
repair) bounds as Ukkonen does; the backtraced audits of all targets of least
cost are compared.

Targets are suffixes of one alternating string, so a single banded matrix over
(turns left, letters left) holds the alignments to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40
NAME = {"u": "user", "a": "assistant"}
#: One byte a turn: 4 * initial (0 s, 1 u, 2 a, 3 other) + 2 * must go + 1 * truncated.
INITIALS = {"s": 0, "u": 1, "a": 2}

RESULT = (
    "id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired array<struct<role:string,text:string>>"
)


def _incumbent(codes: bytes) -> int:
    """Cost of a plain repair: rows that fit stay, others change role, a last assistant is added."""
    cost, want = 0, 1
    for i, c in enumerate(codes):
        if c & 2:
            cost += DELETE
            continue
        fits = c >> 2 == want or (c >> 2 == 0 and i == 0)
        cost += (0 if fits else REROLE) + (TRUNCATED if c & 1 else 0)
        if not (c >> 2 == 0 and i == 0):
            want = 3 - want
    if want == 2 or (len(codes) and codes[0] >> 2 == 0 and all(c & 2 for c in codes[1:])):
        cost += INSERT * (1 if want == 2 else 2)
    return min(cost, DELETE * len(codes))


class Alignment:
    """Banded costs of aligning the turns from i on to the last k letters of ...uaua, and with an s before them."""

    def __init__(self, codes: bytes):
        self.codes, n = codes, len(codes)
        self.bound = _incumbent(codes)
        self.less, self.more = self.bound // DELETE + 1, self.bound // INSERT  # an s uses up a turn, but no letter
        width = self.less + self.more + 1
        # Row i holds k = n - i - less ... n - i + more; the last assistant is letter k = 1.
        self.plain = np.full((n + 1, width), FAR, dtype=np.int64)
        self.system = np.full((n + 1, width), FAR, dtype=np.int64)
        for i in range(n, -1, -1):
            k = np.arange(n - i - self.less, n - i + self.more + 1)
            row = np.full(width, FAR, dtype=np.int64)
            if i == n:
                row[self.less] = 0
            else:
                below, code = self.plain[i + 1], codes[i]
                lower = np.append(below[1:], FAR)  # the same k, a turn further: deleted
                row = lower + DELETE
                if not code & 2:
                    letter = np.where(k % 2 == 1, 2, 1)
                    step = np.where(letter == code >> 2, 0, REROLE) + (TRUNCATED if code & 1 else 0)
                    row = np.minimum(row, below + step)  # k - 1, a turn further
                self.system[i] = np.append(self.system[i + 1][1:], FAR) + DELETE
                if code < 2:
                    self.system[i] = np.minimum(self.system[i], lower + (TRUNCATED if code & 1 else 0))
            row[k <= 0] = np.where(k[k <= 0] < 0, FAR, DELETE * (n - i))
            flat = np.minimum.accumulate(row - INSERT * k) + INSERT * k  # inserts before turn i
            self.plain[i] = np.where(k < 0, FAR, np.minimum(flat, FAR))
            self.system[i] = np.where(k < 0, FAR, np.minimum(self.system[i], FAR))

    def at(self, table: np.ndarray, i: int, k: int) -> int:
        place = k - (len(self.codes) - i) + self.less
        return int(table[i, place]) if 0 <= place < table.shape[1] else FAR

    def targets(self) -> Iterator[tuple[int, bool, int]]:
        """(letters, with a system turn, cost) of each feasible target inside the band; letters don't count the s."""
        n = len(self.codes)
        for k in range(0, n + self.more + 1, 2):
            yield k, False, self.at(self.plain, 0, k)
            if k:
                yield k, True, self.at(self.system, 0, k)

    def backtrace(self, k: int, system: bool) -> str:
        """The ASCII-least of the cheapest audits of one target. A letter leads to one cell only, so the least letter is taken."""
        out, i, n = [], 0, len(self.codes)
        while i < n or k:
            table = self.system if system else self.plain
            left = self.at(table, i, k)
            if i < n:
                code = self.codes[i]
                extra = TRUNCATED if code & 1 else 0
                if self.at(table, i + 1, k) + DELETE == left:
                    out.append("D")
                    i += 1
                    continue
            if k and not system and self.at(table, i, k - 1) + INSERT == left:
                out.append("I")
                k -= 1
                continue
            if system:
                out.append("K")
                system = False
                i += 1
                continue
            same = code >> 2 == (2 if k % 2 else 1)
            out.append("K" if same and self.at(table, i + 1, k - 1) + extra == left else "R")
            i, k = i + 1, k - 1
        return "".join(out)


@lru_cache(maxsize=50_000)
def align(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of audits of the same cost the ASCII-least."""
    if not codes:
        return 0, ""
    a = Alignment(codes)
    best, audit = FAR, ""
    for k, system, cost in a.targets():
        if cost > best or cost >= FAR:
            continue
        trace = a.backtrace(k, system)
        if cost < best or trace < audit:
            best, audit = cost, trace
    return best, audit


def repaired(rows: list[tuple[str, str]], audit: str) -> list[dict]:
    """The turns after an audit's edits."""
    out, i = [], 0
    led = False  # a system turn leads
    for step in audit:
        want = NAME["u" if (len(out) - led) % 2 == 0 else "a"]
        if step == "I":
            out.append({"role": want, "text": ""})
            continue
        role, text = rows[i]
        i += 1
        if step == "K":
            led = led or (not out and role[:1] == "s")
            out.append({"role": role, "text": text})
        elif step == "R":
            out.append({"role": want, "text": text})
    return out


WHITE = " \t\n\x0b\x0c\r"


def examine(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """Faults, cheapest repair and repaired turns of one conversation in order."""
    seen, codes = set(), bytearray()
    blank = duplicate = truncated = illegal = 0
    for j, (role, text) in enumerate(zip(roles, texts, strict=True)):
        code, end = 4 * INITIALS.get(role[:1], 3), text.rstrip(WHITE)
        if not end:
            blank, code = blank + 1, code + 2
        elif (role, text) in seen:
            duplicate, code = duplicate + 1, code + 2
        elif end[-1] not in ".!?":
            truncated, code = truncated + 1, code + 1
        seen.add((role, text))
        codes.append(code)
        illegal += bool(j) and roles[j - 1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = align(bytes(codes))
    known = [t for t in turns if t is not None]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": blank,
        "duplicate": duplicate,
        "truncated": truncated,
        "illegal": illegal,
        "cost": cost,
        "audit": audit,
        "repaired": repaired(list(zip(roles, texts, strict=True)), audit),
    }


SCHEMA = pa.schema(
    [("id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
     ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from sorted rows; the one that is open is held, and some finished ones."""
    done, size, now, turns, roles, texts = [], 0, None, [], [], []

    def close() -> int:
        done.append({"id": now[0], **examine(turns, roles, texts)})
        weight = 100 + sum(map(len, texts))
        turns.clear(), roles.clear(), texts.clear()
        return weight

    for b in batches:
        for key, gone, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("id", "gone", "turn", "role", "text")), strict=True):
            if now is None or now[0] != key:
                size += close() if now is not None else 0
                now = (key,)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_pylist(done, SCHEMA)
                    done, size = [], 0
            if not gone:
                turns.append(turn), roles.append(role), texts.append(text)
    if now is not None:
        close()
    if done:
        yield pa.RecordBatch.from_pylist(done, SCHEMA)


def damage(turns: DataFrame, key: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, gone) with a planted fault a turn, by the crc32 of ``id:turn`` modulo 20.

    0 drops the row (``gone``, so that a conversation without rows is still
    known), 1 empties its text, 2 removes every ``.``, ``!`` and ``?``, 3
    repeats it, 4 makes it a user's. Null ids, turns, roles and texts count as
    one space each.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space(key), space(turn_col)).cast("binary")) % 20
    text = space(text_col)
    rows = turns.select(
        F.col(key).cast("long").alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(space(role_col)).alias("role"),
        F.when(fault <= 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("gone"),
        F.when(fault == 3, F.lit(2)).otherwise(F.lit(1)).alias("_times"),
    )
    return rows.withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).drop("_time", "_times")


def repair(turns: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation of (id, turn, role, text, gone).

    A row counts for its first fault: blank (only ASCII white space),
    duplicate (role and text seen earlier in the conversation), truncated (the
    last other character is none of ``.!?``). Keep costs 0, a new role 3,
    delete 4 (blank and duplicate rows have to go), an inserted empty turn 3;
    a truncated row that stays adds 3. Columns: ``id``, ``gaps`` (turn numbers
    missing between the first and last), ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (neighbours whose role initials are not su, ua
    or au), ``cost``, ``audit`` (initials of the edits in order: D, I, K, R)
    and ``repaired`` (the turns after them).

    Rows are ordered by turn (nulls first), ties by role, then text. Null
    roles and texts are one space. Rows with ``gone`` only say that the
    conversation exists; one without other rows has zeros and an empty repair.
    Rows with a null id are one conversation. Empty tables give an empty
    result; other columns are ignored. A conversation has to fit a task's
    memory, and its matrix holds turns times (7 / 12 of the incumbent cost).
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("id", "turn", space("role"), space("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    placed = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return placed.mapInArrow(_repair, RESULT)
