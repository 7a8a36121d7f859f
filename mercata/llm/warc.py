"""WARC writing with revisits, and a salvage reader.

Archives are concatenated gzip members, one record each. A record whose
payload another record already carries is written as a revisit of it. The
reader checks every member (gzip CRC), header, block length and digest; where
a check fails it searches for the next valid member (or, in an archive that
isn't compressed, the next version line), goes on there, and logs the bytes
it had to leave as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.llm.common import shared_folder, shared_table

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields that every record has.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
MAGIC = b"\x1f\x8b\x08"
#: Namespace of the record ids that are derived from page ids.
RECORDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of an archive that are inflated at once, and the longest header that is read.
STEP, HEADER_MOST = 16 << 10, 1 << 20
VERSION_LINES = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
DATE = "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the full payload's digest and length but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(RECORDS, f'page/{page_id}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head.append(("WARC-Profile", PROFILE))
        if refers_to is not None:
            head.append(("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(RECORDS, f'page/{refers_to}')}>"))
            head.append(("X-Refers-To-Page-ID", str(refers_to)))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Salvage:
    """What an archive yields: records that pass every check, and gaps."""

    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)

    def leave(self, start: int, end: int, reason: str) -> None:
        if end > start:
            self.gaps.append(Gap(start, end, reason))


def parse_record(raw: bytes | memoryview, at: int, offset: int) -> tuple[Record, int]:
    """The record at ``raw[at:]`` and its end; ValueError names the failed check."""
    raw = bytes(raw) if isinstance(raw, memoryview) else raw
    if not raw.startswith(VERSION_LINES, at):
        raise ValueError("no version line")
    headers: dict[str, str] = {}
    # line by line, so that a header that breaks off costs no more than its sound lines
    line_at, last = at + len(VERSION_LINES[0]), at + HEADER_MOST
    while not raw.startswith(b"\r\n", line_at):
        line_end = raw.find(b"\r\n", line_at, last)
        if line_end < 0:
            raise ValueError("header without end")
        name, colon, value = raw[line_at:line_end].partition(b":")
        if not colon or b"\n" in name:
            raise ValueError("header line without colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        line_at = line_end + 2
    head_end = line_at - 2
    missing = [f for f in MANDATORY if not headers.get(f)]
    if missing:
        raise ValueError(f"header without {missing[0]}")
    length = headers["content-length"]
    if not (length.isascii() and length.isdigit()):
        raise ValueError("no content length")
    start, end = head_end + 4, head_end + 4 + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block length")
    block = raw[start:end]
    stated = headers.get("warc-block-digest")
    if stated and stated != f"sha1:{digest_of(block)}":
        raise ValueError("block digest")
    payload = block.partition(b"\r\n\r\n")[2] if "http" in headers.get("content-type", "") else block
    stated = headers.get("warc-payload-digest")
    if stated and headers.get("warc-type") == "response" and stated != f"sha1:{digest_of(payload)}":
        raise ValueError("payload digest")
    return Record(offset, headers, payload), end + 4


def _after_gzip_header(data: bytes, at: int) -> int:
    """Where the deflated bytes of the member at ``data[at:]`` begin; its name and comment are short."""
    flags = data[at + 3] if at + 3 < len(data) else 0xFF
    if flags & 0xE0:
        raise ValueError("gzip: unknown flags")
    place = at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            place = data.find(b"\0", place, place + 4096) + 1
            if place <= 0:
                raise ValueError("gzip: name or comment without end")
    return place + (2 if flags & 2 else 0)


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The member at ``data[at:]`` and its end; fed in steps, so the rest of the archive is never copied."""
    _after_gzip_header(data, at)
    z = zlib.decompressobj(31)
    out, end = [], at
    try:
        while not z.eof and end < len(data):
            step = data[end : end + STEP]
            out.append(z.decompress(step))
            end += len(step)
    except zlib.error as e:
        raise ValueError(f"gzip: {str(e)[:60]}") from None
    if not z.eof:
        raise ValueError("gzip: member cut off")
    return b"".join(out), end - len(z.unused_data)


def _one_member(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """The records of the member at ``data[at:]``, its end, and what was wrong inside it ('' if nothing).

    A member usually holds one record; one that holds several, as an archive
    compressed as a whole does, gives all that pass their checks.
    """
    if not data.startswith(MAGIC, at):
        raise ValueError("no member")
    raw, end = _inflate(data, at)
    inside = Salvage()
    _walk(raw, inside, packed=False)
    if not inside.records:
        raise ValueError(inside.gaps[0].reason if inside.gaps else "empty member")
    for r in inside.records:
        r.offset = at
    return inside.records, end, inside.gaps[0].reason if inside.gaps else ""


class _Next:
    """Where some bytes come next. A found place is kept until it is passed, so that no byte is searched twice."""

    def __init__(self, data: bytes, wanted: bytes):
        self.data, self.wanted, self.place = data, wanted, -1

    def after(self, at: int) -> int:
        """The first place behind ``at``; the end of the data if there is none."""
        if self.place <= at:
            found = self.data.find(self.wanted, at + 1)
            self.place = found if found >= 0 else len(self.data)
        return self.place


def _walk(data: bytes, out: Salvage, packed: bool) -> None:
    """Add the records and gaps of ``data``; ``packed``: gzip members are looked for too."""
    starts = [_Next(data, b"WARC/1."), *([_Next(data, MAGIC)] if packed else [])]
    at, lost, reason = 0, None, ""
    while at < len(data):
        try:
            if packed and data.startswith(MAGIC, at):
                records, end, wrong = _one_member(data, at)
            else:
                record, end = parse_record(data, at, at)
                records, wrong = [record], ""
        except ValueError as e:
            if lost is None:
                lost, reason = at, str(e)
            at = min(s.after(at) for s in starts)
            continue
        if lost is not None:
            out.leave(lost, at, reason)
            lost = None
        out.records += records
        if wrong:
            out.leave(at, end, f"inside the member: {wrong}")
        at = end
    if lost is not None:
        out.leave(lost, len(data), reason)


def salvage(data: bytes) -> Salvage:
    """All records of an archive that pass their checks, gaps for the rest.

    Reads gzip members, of one or several records, and plain records, in any
    order. After a failed check the search goes on behind it, at the next
    member or version line that starts a record which passes; all bytes before
    it are one gap. A sound member that holds other bytes beside its records
    is told as a gap too, by the member's place. No byte is searched twice, and
    a header is read up to ``HEADER_MOST`` bytes, so time grows with the
    archive, whatever the damage.

    A record inside the payload of a damaged record can't be told from one
    that follows it: if it passes its checks, it is recovered like any other.
    """
    out = Salvage()
    _walk(data, out, packed=True)
    return out


def _writer(folder: str, most_bytes: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        try:
            for b in batches:
                for page, url, payload, refers, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    raw = member(record(page, url, payload or b"", refers, revisit))
                    if out is not None and size + len(raw) > most_bytes:
                        out.close()
                        done.append((name, size, count))
                        out = None
                    if out is None:
                        name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(raw)
                    size, count = size + len(raw), count + 1
        finally:
            if out is not None:
                out.close()
                done.append((name, size, count))
        yield pa.record_batch(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            names=["archive", "bytes", "records"],
        )

    return write


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit) for every page."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    first = base.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return base.join(first, "sha", "left").select(
        "page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """Write a record per row; (archive, bytes, records) per archive written.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with
    the smallest page id are responses and the others revisit it; rows with
    smaller payloads are all responses. Null html is an empty payload. Rows
    that repeat the smallest id are each a response; rows with a null id
    revisit any other, and are responses if there is none. No row, no archive.

    An archive takes records up to ``most_bytes`` (a larger record has one of
    its own). Each task attempt writes archives under names of its own and
    only names those it finished, so what a lost executor left is never read.
    """
    planned = plan_records(pages, id_col, url_col, html_col, min_bytes)
    return shared_table(
        planned.mapInArrow(_writer(folder, most_bytes), "archive string, bytes long, records long"), "warc-manifest"
    )


def _reader(gaps: bool) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = salvage(content.as_py())
                if gaps:
                    yield pa.record_batch(
                        [
                            pa.array([path] * len(found.gaps), pa.string()),
                            pa.array([g.start for g in found.gaps], pa.int64()),
                            pa.array([g.end for g in found.gaps], pa.int64()),
                            pa.array([g.reason for g in found.gaps], pa.string()),
                        ],
                        names=["archive", "start", "end", "reason"],
                    )
                    continue
                number = lambda r, k: int(r.headers[k]) if r.headers.get(k, "").lstrip("-").isdigit() else None
                recs = found.records
                revisit = [r.headers.get("warc-type") == "revisit" for r in recs]
                yield pa.record_batch(
                    [
                        pa.array([path] * len(recs), pa.string()),
                        pa.array([r.offset for r in recs], pa.int64()),
                        pa.array([r.headers.get("warc-type") for r in recs], pa.string()),
                        pa.array([r.headers.get("warc-target-uri") for r in recs], pa.string()),
                        pa.array([number(r, "x-page-id") for r in recs], pa.int64()),
                        pa.array([number(r, "x-refers-to-page-id") for r in recs], pa.int64()),
                        pa.array(
                            [number(r, "x-payload-length") if v else len(r.payload) for r, v in zip(recs, revisit, strict=True)],
                            pa.int64(),
                        ),
                        pa.array(
                            [
                                (r.headers.get("warc-payload-digest") or "").removeprefix("sha1:") if v else digest_of(r.payload)
                                for r, v in zip(recs, revisit, strict=True)
                            ],
                            pa.string(),
                        ),
                        pa.array([None if v else r.payload for r, v in zip(recs, revisit, strict=True)], pa.binary()),
                    ],
                    names=["archive", "offset", "type", "url", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload"],
                )

    return read


_RECORD = (
    "archive string, offset long, type string, url string, page_id long, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _archives(spark: SparkSession, folder: str, manifest: DataFrame | None) -> DataFrame | None:
    if manifest is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    names = [f"{folder}/{r['archive']}" for r in manifest.select("archive").toLocalIterator()]
    if not names:
        return None
    return spark.read.format("binaryFile").load(names).select("path", "content")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, keep_payload: bool = True) -> DataFrame:
    """The records of a folder's archives (those of the manifest, if one is given).

    Columns: archive, offset, type, url, page_id, refers_to, payload_bytes and
    payload_digest (both of the full payload, for revisits too), payload (null
    for revisits). Damaged bytes are passed over; ``read_gaps`` lists them.
    """
    files = _archives(spark, folder, manifest)
    if files is None:
        return spark.createDataFrame([], _RECORD)
    out = files.mapInArrow(_reader(False), _RECORD)
    return out if keep_payload else out.drop("payload")


def read_gaps(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """(archive, start, end, reason) for each run of bytes that no record covers."""
    schema = "archive string, start long, end long, reason string"
    files = _archives(spark, folder, manifest)
    if files is None:
        return spark.createDataFrame([], schema)
    return files.mapInArrow(_reader(True), schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    manifest = write_archives(pages, folder, min_bytes=min_bytes)
    return read_archives(spark, folder, manifest, keep_payload=False)
