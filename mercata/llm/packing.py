"""Hierarchical multi-length packing.

Documents are routed by length to tiers of context sizes. The tiers are
packed from the longest down; the gap that is left in a longer window is
filled with whole documents of its own or a shorter tier, and its last rest
with a piece cut off the shortest. The sequences of a tier are then dealt to
steps of equal tokens, those of like attention cost together.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercata.llm.common import shared_table

#: Context sizes, all powers of two.
TIERS = (256, 512, 1024, 2048, 4096)
#: Characters of chunks that a tokenizer remembers.
REMEMBERED = 6_000_000
#: Stands between chunks that are encoded together, and between texts that are split together.
_BETWEEN = "\x01"
#: Here white space and the tokenizer's own may differ, or the mark above or a special token may stand.
_ODD = b"\x01\x1c\x1d\x1e\x1f"
_DIRECT = ("\x85".encode(), b"<|")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123)]] = True
#: Second bytes of Latin letters that begin with 0xC3 (all but the multiplication and division signs).
_LATIN = np.zeros(256, bool)
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True


#: Byte-level models write bytes as characters: printable ones as they are, the others from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def part_marks(text: bytes) -> bytes:
    """Put a space before each full stop or comma between a letter or digit and white space.

    There a token ends on both sides, so the words before the marks are met
    again and again without them.
    """
    a = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((a[2:-1] == 46) | (a[2:-1] == 44)) + 2
    after, before = a[at + 1], a[at - 1]
    letter = _LETTER[before] | (_LATIN[before] & (a[at - 2] == 0xC3))
    return np.insert(a, at[letter & ((after == 32) | (after == 10))], 32).tobytes()


class ChunkTokenizer:
    """A tokenizer that encodes each distinct chunk of a text once.

    For tokenizers that never join text across white space: the ids of a text
    are then those of its chunks, joined. A-Z may be lower-cased first, as the
    tokenizer does so itself. Texts in which this isn't sure are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.size = 0
        (self.between,) = self.whole(_BETWEEN)

    def whole(self, text: str) -> np.ndarray:
        (done,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(done.ids, dtype="<u2")

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks: words of plain or Latin letters by the model alone, others whole.

        Such a word is one token of the splitter and is changed by the
        normaliser in nothing but case, so only the model's merges are left.
        """
        self.size += sum(map(len, chunks))
        merge, rest = self.tokenizer.model.tokenize, []
        for c in chunks:
            if not c.isalpha() or max(c) > "\xff":
                rest.append(c)
                continue
            word = c if c.isascii() else c.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
            self.known[c] = _uint16([t.id for t in merge(word)])
        self._learn_whole(rest)

    def _learn_whole(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            ids = self.whole(f" {_BETWEEN} ".join(part))
            ends = np.append(np.flatnonzero(ids == self.between), len(ids)) * 2
            raw, begin = ids.tobytes(), 0
            for chunk, end in zip(part, ends.tolist(), strict=True):
                self.known[chunk] = raw[begin:end]
                begin = end + 2

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit numbers."""
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        out: list[bytes] = [b""] * len(texts)
        own, raw = [], []
        for i, text in enumerate(texts):
            data = (text or "").encode()
            if any(x in data for x in _DIRECT) or len(data.translate(None, _ODD)) < len(data):
                out[i] = self.whole(text).tobytes()
            else:
                own.append(i)
                raw.append(data.lower())
        border = f"\n{_BETWEEN}\n"
        parted = part_marks(b"\n\n" + border.encode().join(raw) + b"\n\n").decode()
        chunks = [t.split() for t in parted.split(border)][: len(own)]
        found = [list(map(self.known.get, c)) for c in chunks]
        missing = [_places(f) for f in found]
        self._learn(list({c[k] for c, m in zip(chunks, missing, strict=True) for k in m}))
        for i, c, f, m in zip(own, chunks, found, missing, strict=True):
            for k in m:
                f[k] = self.known[c[k]]
            out[i] = b"".join(f)
        return out


def _uint16(ids: list[int]) -> bytes:
    """Little-endian, whatever the machine."""
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _places(values: list[bytes | None]) -> list[int]:
    """Where a list has None."""
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


@dataclass(frozen=True, order=True)
class Piece:
    """``length`` ids of document ``doc`` from ``start`` on."""

    length: int
    doc: int
    start: int


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The shortest context size that holds ``length`` ids."""
    return next(t for t in tiers if length <= t)


class Packer:
    """Packs pieces; what doesn't fill a window waits for the next documents."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.waiting: list[Piece] = []

    def add(self, doc: int, length: int) -> list[tuple[int, list[Piece]]]:
        """Route a document; the windows that it fills by itself come back."""
        top = self.tiers[-1]
        whole = length // top
        if length % top:
            insort(self.waiting, Piece(length % top, doc, whole * top))
        return [(top, [Piece(top, doc, i * top)]) for i in range(whole)]

    def _fill(self, window: int) -> list[Piece] | None:
        """One full window of the longest waiting pieces, or None if they can't fill it."""
        out, gap = [], window
        while gap and self.waiting:
            at = bisect_right(self.waiting, gap, key=lambda p: p.length)
            if at:
                out.append(self.waiting.pop(at - 1))
            else:
                p = self.waiting.pop(0)
                out.append(Piece(gap, p.doc, p.start))
                insort(self.waiting, Piece(p.length - gap, p.doc, p.start + gap))
            gap -= out[-1].length
        if gap:
            for p in out:
                insort(self.waiting, p)
            return None
        return out

    def windows(self, last: bool) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows, longest tier first; at the end all that waits is used."""
        while self.waiting:
            window = tier_of(self.waiting[-1].length, self.tiers)
            filled = self._fill(window)
            if filled is None:
                break
            yield window, filled
        if last:
            rest = sum(p.length for p in self.waiting)
            while rest:
                window = min(1 << rest.bit_length() - 1, self.tiers[-1])
                yield window, self._fill(window) or []
                rest -= window


def steps_of(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A step for each sequence: equal tokens, one context size, like attention cost.

    Attention cost is the sum of squared piece lengths, so the sequences of a
    step take about as long as each other.
    """
    cost = [sum(p.length * p.length for p in pieces) for _, pieces in windows]
    order = sorted(range(len(windows)), key=lambda i: (-windows[i][0], -cost[i], i))
    out, step, room, size = [0] * len(windows), -1, 0, 0
    for i in order:
        if windows[i][0] != size or not room:
            step, size = step + 1, windows[i][0]
            room = max(1, step_tokens // size)
        out[i] = step
        room -= 1
    return out


PIECE_COLUMNS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step", "part", "ids"]
#: Partitions whose last pieces are packed together, and more partitions than a job has.
TOGETHER, PARTITIONS = 256, 1 << 30


def _pack(path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, held_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokenizer = ChunkTokenizer(path)
        end = np.array([end_id], dtype="<u2").tobytes()
        packer, ids, names = Packer(tiers), {}, {}
        full: list[tuple[int, list[Piece]]] = []
        held = number = sequence = step = 0

        def out() -> pa.RecordBatch:
            nonlocal full, held, sequence, step
            full.extend(packer.windows(False))
            own = steps_of(full, step_tokens)
            rows: list[tuple] = []
            for (window, pieces), s in zip(full, own, strict=True):
                offset = 0
                for p in pieces:
                    cut = np.frombuffer(ids[p.doc], "<u2")[p.start : p.start + p.length]
                    crc = zlib.crc32(cut.astype("<u4").tobytes())
                    rows.append((p.doc, p.start, p.length, crc, len(ids[p.doc]) // 2, (part << 32) + sequence, offset, window, (part << 32) + step + s))
                    offset += p.length
                sequence += 1
            step += max(own, default=-1) + 1
            at = pa.array([names[r[0]] for r in rows], id_type)
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 9)]
            full, held = [], 0
            wait = {p.doc for p in packer.waiting}
            for d in [d for d in ids if d not in wait]:
                del ids[d], names[d]
            none = pa.nulls(len(rows), pa.binary())
            return pa.record_batch([at, *columns, pa.array(np.full(len(rows), part), pa.int32()), none], names=PIECE_COLUMNS)

        def left() -> pa.RecordBatch:
            """What fills no window here, with its ids."""
            wait = packer.waiting
            cut = [ids[p.doc][2 * p.start : 2 * (p.start + p.length)] for p in wait]
            nothing = pa.nulls(len(wait), pa.int64())
            columns = [pa.array([p.start for p in wait], pa.int64()), pa.array([p.length for p in wait], pa.int64()), nothing]
            columns += [pa.array([len(ids[p.doc]) // 2 for p in wait], pa.int64()), nothing, nothing, nothing, nothing]
            at = pa.array([names[p.doc] for p in wait], id_type)
            return pa.record_batch([at, *columns, pa.array(np.full(len(wait), part), pa.int32()), pa.array(cut, pa.binary())], names=PIECE_COLUMNS)

        id_type = pa.int64()
        for whole in batches:
            id_type = whole.column(0).type
            for begin in range(0, whole.num_rows, 512):
                b = whole.slice(begin, 512)
                for name, own in zip(b.column(0).to_pylist(), tokenizer.encode(b.column(1).to_pylist()), strict=True):
                    ids[number], names[number] = own + end, name
                    full.extend(packer.add(number, len(own) // 2 + 1))
                    held += len(own) // 2 + 1
                    number += 1
                if held >= held_tokens:
                    yield out()
        yield out()
        yield left()

    return run


def _pack_rests(tiers: tuple[int, ...], step_tokens: int) -> Callable[[pa.Table], pa.Table]:
    """The pieces that filled no window of their partition, packed together: those of at most ``TOGETHER`` partitions."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("length", "ascending"), ("doc_tokens", "ascending"), ("ids", "ascending")]).combine_chunks()
        group = t.column("bundle")[0].as_py()
        ids, start = t.column("ids").to_pylist(), t.column("start").to_pylist()
        packer = Packer(tiers)
        for i, own in enumerate(ids):
            insort(packer.waiting, Piece(len(own) // 2, i, 0))
        full = list(packer.windows(True))
        first = (PARTITIONS + group) << 32
        rows = []
        for n, ((window, pieces), step) in enumerate(zip(full, steps_of(full, step_tokens), strict=True)):
            offset = 0
            for p in pieces:
                cut = np.frombuffer(ids[p.doc], "<u2")[p.start : p.start + p.length]
                rows.append((p.doc, start[p.doc] + p.start, p.length, zlib.crc32(cut.astype("<u4").tobytes()), first + n, offset, window, first + step))
                offset += p.length
        at = pa.array([r[0] for r in rows], pa.int64())
        column = lambda i: pa.array([r[i] for r in rows], pa.int64())
        values = [t.column("id").take(at), column(1), column(2), column(3), t.column("doc_tokens").take(at), *map(column, range(4, 8))]
        return pa.table(dict(zip(PIECE_COLUMNS[:9], values, strict=True)))

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 32 * 1024,
    held_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: which ids of which document stand where.

    Columns: the id column, ``start`` (ids of the document before the piece),
    ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit
    numbers), ``doc_tokens`` (of the document, with the end id), ``sequence_id``,
    ``offset`` in the sequence, ``window`` (the context size, a power of two
    that the sequence fills exactly) and ``step`` (group of sequences with
    ``step_tokens`` ids, fewer where a tier runs out).

    A document's ids are those of the tokenizer without special tokens, then
    ``end_id``; each id lies in exactly one piece. A null or empty text has
    the end id alone. Rows that repeat are documents of their own, null ids
    stay null. An empty table gives an empty result; other columns are ignored.

    Each partition packs its own documents as they stream by, about
    ``held_tokens`` ids at once; a partition that is run again packs alike.
    Tiers are packed full from the longest down. What fills no window at a
    partition's end, below 4,096 ids, is written with its ids and packed again
    with that of up to ``TOGETHER`` partitions; only there the last ids are cut
    into shorter powers of two, a few sequences for all of them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType().add("id", docs.schema[id_col].dataType)
    for name in PIECE_COLUMNS[1:9]:
        schema = schema.add(name, "long")
    first = rows.mapInArrow(
        _pack(tokenizer_path, end_id, tiers, step_tokens, held_tokens),
        StructType([*schema.fields]).add("part", "integer").add("ids", "binary"),
    )
    pieces = shared_table(first, "pieces")
    rests = pieces.where("ids IS NOT NULL").withColumn("bundle", F.floor(F.col("part") / TOGETHER).cast("int"))
    packed = pieces.where("ids IS NULL").select(PIECE_COLUMNS[:9]).unionByName(
        rests.groupBy("bundle").applyInArrow(_pack_rests(tiers, step_tokens), schema)
    )
    return packed.withColumnRenamed("id", id_col)
