"""WARC archives: a writer with revisit records and a salvage reader.

Writing: of records with equal payloads (by SHA-1) of at least ``min_revisit`` bytes the one with the largest id becomes
the response, and the others become revisits without payload that name it; every record is a gzip member of its own.
Archives are byte strings of about ``archive_bytes``, one row each of a Parquet data set in the shared folder, so that a
lost executor leaves no half archive.

Reading (:func:`read_archive`) checks every record: framing, lengths, and the payload digest.  After a failed check it
searches for the next member that inflates or the next version line, goes on there, and logs the bytes between as a
quarantined gap with the reason.  A damaged member of several records is inflated as far as it goes, and the same search
runs inside its content: records whose block digests fit are kept, and the member is logged with the places lost.  A
revisit's payload comes from its response by a join on the digest.

Defined cases: a null html is an empty payload, a null url an empty target; control characters of a url are written as
%XX; urls and payloads have no greatest length; page ids must be unique to be told apart, repeated rows give repeated
records, and rows without an id are responses; an empty table gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, staged

VERSION = b"WARC/1.1"
_GZIP = b"\x1f\x8b\x08"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Every record's date: the tables have none, and archives are to be equal for equal input.
_DATE = b"1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class WarcParams:
    min_revisit: int = 0
    archive_bytes: int = 4 << 20
    level: int = 1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:null>" if page_id is None else b"<urn:page:%d>" % page_id


#: A head's line cannot hold these; they are written as %XX.
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record with its HTTP head; a revisit has the head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", _urn(page_id)),
        (b"WARC-Date", _DATE),
        (b"WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url).encode()),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"WARC-Payload-Digest", b"sha1:" + sha1.encode()),
        (b"WARC-Block-Digest", b"sha1:" + digest(block).encode()),
        (b"Content-Length", b"%d" % len(block)),
    ]
    if refers_to is not None:
        fields[5:5] = [(b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", _urn(refers_to))]
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    """A record failed a check."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at ``at``."""
    if not data.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("the head does not end")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a head line without a colon")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    block = data[start:stop]
    if (want := fields.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest(block):
        raise Damaged("the block digest differs")
    return fields, block, stop + 4


_PIECE = 1 << 16


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """Of the gzip member at ``at``: its content, its end and an empty reason; where it is cut off or does not inflate to
    its own checksum, what came out before, None and the reason.  Bytes behind the member are not touched."""
    engine, view, out, fed = zlib.decompressobj(31), memoryview(data), [], at
    while fed < len(data):
        piece = view[fed : fed + (_PIECE if fed > at else 4096)]
        kept = engine.copy()
        try:
            out.append(engine.decompress(piece))
        except zlib.error as error:
            try:  # to the byte before the error
                for k in range(len(piece)):
                    out.append(kept.decompress(piece[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(out), None, f"a member does not inflate: {error}"
        fed += len(piece)
        if engine.eof:
            return b"".join(out), fed - len(engine.unused_data), ""
    return b"".join(out), None, "a member is cut off"


def _inside(content: bytes, checked: bool) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """Records and gaps of a member's content; unless the member's checksum fits, records need a block digest."""
    records, gaps, at = [], [], 0
    while at < len(content):
        try:
            fields, block, stop = parse_record(content, at)
            if not checked and not fields.get("warc-block-digest", "").startswith("sha1:"):
                raise Damaged("no block digest in a damaged member")
            records.append((fields, block))
        except Damaged as error:
            stop = _next_line(content, at + 1)
            gaps.append((at, stop, str(error)))
        at = stop
    return records, gaps


def read_archive(data: bytes) -> tuple[list[tuple[int, dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """Records (offset, fields, block) and quarantined gaps (start, end, reason) of an archive, gzipped or not.

    Offsets in a gzipped archive are those of members; the reason names the places lost in a member's content."""
    records: list[tuple[int, dict[str, str], bytes]] = []
    gaps: list[tuple[int, int, str]] = []
    at = 0
    while at < len(data):
        begin = at
        if data.startswith(_GZIP, at):
            content, stop, broken = _inflate(data, at)
            got, lost = _inside(content, not broken)
            if broken and not lost and len(got) < 2:
                got = []  # the damage is in this record, where its digest does not reach
            records += [(begin, *r) for r in got]
            at = _next_start(data, begin + 1) if stop is None else stop
            if broken or lost or not content:
                reasons = [broken or ("" if content else "an empty member"), *(f"content {a} to {b}: {why}" for a, b, why in lost)]
                gaps.append((begin, at, "; ".join(filter(None, reasons))))
            continue
        try:
            fields, block, at = parse_record(data, at)
            records.append((begin, fields, block))
        except Damaged as error:
            at = _next_start(data, begin + 1)
            gaps.append((begin, at, str(error)))
    return records, gaps


def _is_line(data: bytes, at: int) -> bool:
    """Whether the version line at ``at`` begins a record: it begins a line, or the record parses."""
    if at == 0 or data[at - 1 : at] == b"\n":
        return True
    try:
        parse_record(data, at)
        return True
    except Damaged:
        return False


def _next_line(data: bytes, at: int) -> int:
    """The next version line."""
    while (found := data.find(b"WARC/1.", at)) >= 0:
        if _is_line(data, found):
            return found
        at = found + 1
    return len(data)


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def _next_start(data: bytes, at: int) -> int:
    """The next offset at which a record can begin: a member that inflates to a version line, or a version line."""
    for found in _START.finditer(data, at):
        if found[0] != _GZIP:
            if _is_line(data, found.start()):
                return found.start()
            continue
        try:
            if zlib.decompressobj(31).decompress(memoryview(data)[found.start() : found.start() + _PIECE], 16).startswith(b"WARC/1."):
                return found.start()
        except zlib.error:
            continue
    return len(data)


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", params: WarcParams = WarcParams()) -> DataFrame:
    """(first_id, n_records, data): archives of all pages.  The SHA-1 grouping moves ids and digests only."""
    prepare(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    keys = own.select("id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    groups = keys.filter(F.col("n") >= params.min_revisit).groupBy("sha1").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("k"))
    groups = groups.filter("k > 1").select(F.col("sha1").alias("s"), "last")
    revisits = keys.join(groups, (F.col("sha1") == F.col("s")) & (F.col("n") >= params.min_revisit)).filter("id != last").select(F.col("id").alias("r"), "last").distinct()
    marked = own.join(revisits, F.col("id") == F.col("r"), "left").select("id", "url", "payload", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        first, size = None, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["first_id", "n_records", "data"])

        for batch in batches:
            for i, u, p, r in zip(*(batch.column(k) for k in range(4)), strict=True):
                body = p.as_py()
                held.append(member(record(i.as_py(), u.as_py(), body, digest(body), r.as_py()), params.level))
                first = i.as_py() if first is None else first
                size += len(held[-1])
                if size >= params.archive_bytes:
                    yield flush()
                    held, first, size = [], None, 0
        if held:
            yield flush()

    return staged(marked.mapInArrow(run, "first_id long, n_records long, data binary"), "archives")


_READ = "page_id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, sound boolean, payload binary, gap_start long, gap_end long, reason string"


def read_archives(archives: DataFrame, data: str = "data", keep_payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records and gaps of archives (any rows with a binary column, such as ``binaryFile``'s ``content``), parsed once.

    Records: page_id, uri, record_type, refers_to, payload_digest, payload_bytes (of the record itself), ``sound`` (its
    digest fits its payload; a revisit has none to check) and, with ``keep_payload``, payload.  Gaps: gap_start, gap_end,
    reason.
    """
    prepare(archives.sparkSession)
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string()]

    def number(value: str | None) -> int | None:
        tail = (value or "").rstrip(">").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                records, gaps = read_archive(cell.as_py() or b"")
                rows = []
                for _, f, block in records:
                    kind = f.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    want = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    sound = kind == "revisit" or want == digest(payload)
                    rows.append((number(f.get("warc-record-id")), f.get("warc-target-uri"), kind, number(f.get("warc-refers-to")), want, len(payload), sound, payload if keep_payload else None, None, None, None))
                rows += [(None,) * 8 + gap for gap in gaps]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    read = staged(archives.select(F.col(data).alias("data")).mapInArrow(run, _READ), "records")
    return read.filter("record_type IS NOT NULL").select(*names[:8]), read.filter("record_type IS NULL").select(*names[8:])


def resolved(records: DataFrame) -> DataFrame:
    """Per record its full payload's size and digest; a revisit takes both from its response.

    No record is left out: where a payload does not fit its digest, or the response of a revisit is not there, both are
    null."""
    rows = records.select("page_id", F.when(F.col("sound"), F.col("payload_bytes")).alias("n"), F.when(F.col("sound"), F.col("payload_digest")).alias("d"), "payload_digest", "record_type", "refers_to")
    answers = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("to"), F.col("d").alias("of")).agg(F.max("n").alias("size"))
    own = rows.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    back = rows.filter("record_type = 'revisit'").join(answers, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("of")), "left")
    return own.union(back.select("page_id", "size", "of", "record_type", "refers_to"))


def expect_whole(records: DataFrame, gaps: DataFrame) -> DataFrame:
    """``records``, or an error if bytes were quarantined or a payload does not fit its digest: for archives written here."""
    lost = gaps.limit(1).collect()
    torn = records.filter(~F.col("sound")).limit(1).select("page_id").collect()
    if lost or torn:
        raise ValueError(f"the archives are damaged: {(lost or torn)[0]}")
    return records
