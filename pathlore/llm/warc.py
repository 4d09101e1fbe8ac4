"""WARC archives: writing records in segments with chunked transfer framing, and reassembly.

Writing: each page is one record, whose id is made of the page_id and the payload's digest. Of pages
with equal payloads of ``MIN_REVISIT`` bytes or more, those with the smallest page_id are responses
and the others revisit records that refer to it. A response's HTTP message has a chunked body; its
block is cut into segments, the first in the response record, the others in continuation records.
Spark's text writer, with the archive's record end as line end, writes the files, so any store that
Spark can write to will do; gzip covers a file, not each record, and there are no warcinfo records.

Reading takes any WARC files (plain, or gzip by file or by record) of up to Spark's 2 GB for a binary
file; a file is inflated piece by piece, so a task holds its packed bytes and the record at hand.
Records are cut by their Content-Length; segments are grouped by the origin's record id, ordered by
segment number, checked against the total length, joined, and the chunked framing is decoded. A
SHA-256 or SHA-1 payload digest is checked. ``error`` tells what is wrong with a record that fails,
or with the rest of a file that is cut short or no archive; the payload is null then. page_id and
refers_to are null where a record id isn't one of this writer's.

Nulls: a null html is an empty payload; a null url has no target header; a null page_id is never
the smallest of a group that has another id. Page ids are whole numbers; a text that is none counts as a null one. Rows that share page_id and payload have one record
id; each is written, and read back as a row of its own. Payloads may have any length up to 2 GB. An empty table gives
an archive without records, and reads as an empty result. Other columns of the pages are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder, slices, small

END = b"\r\n\r\n"
MIN_REVISIT, SEGMENT, CHUNK, RECORDS_PER_FILE, PIECE = 100, 8192, 3000, 4096, 1 << 20
_URN = "urn:pathlore:page:"
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)  # ValueError if it is none
        at = line + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) < size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        at += size + 2


def _record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {_DATE}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def records(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record of one page, with its continuation records, each without the record end."""
    uri = None if url is None else "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    common = {"WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        yield _record("revisit", common | {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        own = common | ({"WARC-Segment-Number": 1} if len(parts) > 1 else {})
        if n > 1:
            own = {"WARC-Record-ID": f"<{record_id}:{n}>", "WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if n == len(parts) else None}
        yield _record("response" if n == 1 else "continuation", own, part)


class Inflated:
    """The bytes of a file, plain or in gzip members, piece by piece as far as they go; then ``error`` says what is wrong, if anything is."""

    def __init__(self, content: bytes):
        self.content, self.error = memoryview(content), None

    def __iter__(self) -> Iterator[bytes]:
        at = 0
        while bytes(self.content[at : at + 2]) == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            while not member.eof:
                piece = member.unconsumed_tail
                if not piece:
                    piece = self.content[at : at + PIECE]
                    at += len(piece)
                try:
                    out = member.decompress(piece, PIECE)
                except zlib.error:
                    self.error = "gzip data is damaged"
                    return
                if out:
                    yield out
                elif not len(piece) and not member.eof:
                    self.error = "gzip data is cut short"
                    return
            at -= len(member.unused_data)
        for a in range(at, len(self.content), PIECE):
            yield bytes(self.content[a : a + PIECE])


class _Ahead:
    """Bytes that come in pieces, of which a few are held: ``data`` from place ``gone`` on."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.data, self.gone = iter(pieces), b"", 0

    def holds(self, n: int) -> bool:
        """Whether n bytes are there, after taking as many pieces as that needs."""
        held, size = [self.data], len(self.data)
        while size < n and (piece := next(self.pieces, None)) is not None:
            held.append(piece)
            size += len(piece)
        if len(held) > 1:
            self.data = b"".join(held)
        return size >= n

    def drop(self, n: int) -> None:
        self.data, self.gone = self.data[n:], self.gone + n


def parse(data: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and blocks of an archive's records, by Content-Length; ValueError at what is no whole record.

    Bytes in pieces are held as far as the record at hand goes, and ``PIECE`` more.
    """
    ahead, at = _Ahead([data] if isinstance(data, bytes) else data), 0
    while ahead.holds(at + 1):
        ahead.holds(at + 5)
        while (stop := ahead.data.find(END, at)) < 0 and ahead.data[at : at + 5] == b"WARC/" and ahead.holds(len(ahead.data) + 1):
            pass
        lines = ahead.data[at : max(stop, at)].decode(errors="replace").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {ahead.gone + at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = headers.get("content-length", "")
        if not size.isascii() or not size.isdigit():
            raise ValueError(f"no content length at byte {ahead.gone + at}")
        end = stop + 4 + int(size)
        if not ahead.holds(end + 4) or ahead.data[end : end + 4] != END:
            raise ValueError(f"record at byte {ahead.gone + at} is cut short")
        yield headers, ahead.data[stop + 4 : end]
        at = end + 4
        if at > PIECE:
            ahead.drop(at)
            at = 0


def _fits(digest: str, payload: bytes) -> bool:
    """Whether a digest header (sha256 or sha1, hex or base 32) is that of the payload; others are not checked."""
    kind, _, value = digest.partition(":")
    if kind.lower() not in ("sha256", "sha1"):
        return True
    own = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def payload_of(segments: list[tuple[int, bytes, int | None]], digest: str | None, http: bool = True) -> bytes:
    """The payload from (number, block, total length) of all segments of a record; ValueError if they don't fit."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or doubled")
    block = b"".join(s[1] for s in segments)
    total = segments[-1][2]
    if len(segments) > 1 and total is None or total is not None and total != len(block):
        raise ValueError("total length differs")
    head, _, body = block.partition(END) if http else (b"", b"", block)
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest is not None and not _fits(digest, payload) and not _fits(digest, body):  # some writers digest the framed body
        raise ValueError("digest differs")
    return payload


def archive_path(spark: SparkSession) -> str:
    """A new folder below the shared folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"{_URN}{'-' if page_id is None else page_id}:{digest}"


def page_of(urn: str | None) -> int | None:
    """The page_id in a record id of this writer, else null."""
    own = (urn or "").strip("<>")
    own = own.removeprefix(_URN).split(":")[0] if own.startswith(_URN) else ""
    return int(own) if re.fullmatch(r"-?[0-9]{1,19}", own) else None


def write_archive(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes (page_id, url, html) as gzip archives below ``path``."""
    own = pages.select(F.expr("try_cast(page_id AS long)").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    groups = own.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only groups of copies are joined; written, so that the join can split a payload that many pages have
    roles = own.join(small(checkpoint(groups)), "digest", "left").withColumn("refers_to", F.when(~F.col("low").eqNullSafe(F.col("page_id")), F.col("low")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            out = []
            for r in b.to_pylist():
                to = None if r["refers_to"] is None else record_id(r["refers_to"], r["digest"])
                out += records(record_id(r["page_id"], r["digest"]), r["url"], r["html"].encode(), r["digest"], to, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    archive = roles.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "value binary")
    # a cast from binary keeps the bytes as they are, also where a segment ends within a character
    archive.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, record_type, payload binary, payload_digest, refers_to, error): a row for each record.

    ``payload_digest`` is the payload's SHA-256, of a revisit that which its header gives.
    """

    def row(h: dict[str, str], block: bytes) -> tuple:
        first = h.get("warc-type") != "continuation"
        origin = h.get("warc-record-id" if first else "warc-segment-origin-id")
        n, total = h.get("warc-segment-number", "1"), h.get("warc-segment-total-length")
        if not origin or not n.isdigit() or total is not None and not total.isdigit():
            raise ValueError("record id or segment number is missing")
        own = h.get("warc-record-id") if first else None
        http = "application/http" in h.get("content-type", "").lower() if first else None
        return origin.strip("<>"), int(n), block, int(total) if total else None, h.get("warc-type", "unknown") if first else None, page_of(own), h.get("warc-payload-digest"), page_of(h.get("warc-refers-to")), http, None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size, bad, wrong = [], 0, [], None
                data = Inflated(content.as_buffer())
                try:
                    for n, (h, block) in enumerate(parse(data)):
                        try:
                            rows.append(row(h, block))
                        except ValueError as e:
                            bad.append((f"{name}#{n}", str(e)))
                        size += len(block)
                        if len(rows) == 512 or size > 4 << 20:
                            yield _batch(rows, _PARTS)
                            rows, size = [], 0
                except ValueError as e:
                    wrong = str(e)
                if wrong := data.error or wrong:
                    bad.append((f"{name}#rest", wrong))
                rows += [(origin, 1, None, None, None, None, None, None, None, error) for origin, error in bad]
                if rows:
                    yield _batch(rows, _PARTS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("path", "content")
    parts = files.mapInArrow(cut, "origin string, n int, block binary, total long, kind string, page_id long, digest string, refers_to long, http boolean, error string")
    whole = parts.groupBy("origin").agg(  # a set, so records that are there twice are kept once, and counted
        F.collect_set(F.struct("n", "block", "total")).alias("segments"),
        F.count("kind").alias("copies"),
        *(F.max(c).alias(c) for c in ("kind", "page_id", "digest", "refers_to", "http", "error")),
    )

    def joined(r: dict) -> tuple[bytes | None, str | None, str | None]:
        """Payload, digest and error of a record's segments."""
        header = r["digest"] or ""
        digest = header.partition(":")[2].lower() if header.lower().startswith("sha256:") else None
        if r["error"] is not None or r["kind"] == "revisit":
            return None, digest, r["error"]
        if r["kind"] is None:
            return None, digest, "first segment is missing"
        try:
            payload = payload_of([(s["n"], s["block"], s["total"]) for s in r["segments"]], r["digest"], r["http"])
        except ValueError as e:
            return None, digest, str(e)
        return payload, digest or hashlib.sha256(payload).hexdigest(), None

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for at in range(0, b.num_rows, 16):
                for r in b.slice(at, 16).to_pylist():
                    payload, digest, error = joined(r)
                    for _ in range(max(1, r["copies"])):
                        rows.append((r["origin"], r["page_id"], r["kind"], payload, digest, r["refers_to"], error))
                        size += 64 + len(payload or b"")
                        if size > 4 << 20:
                            yield _batch(rows, _RECORDS)
                            rows, size = [], 0
            if rows:
                yield _batch(rows, _RECORDS)

    return whole.mapInArrow(join, "record_id string, page_id long, record_type string, payload binary, payload_digest string, refers_to long, error string")


_PARTS = pa.schema([("origin", pa.string()), ("n", pa.int32()), ("block", pa.binary()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("http", pa.bool_()), ("error", pa.string())])
_RECORDS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def digests(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error); a revisit's size is that of the response it refers to."""
    own = checkpoint(records.select("page_id", F.octet_length("payload").cast("long").alias("own"), "payload_digest", "record_type", "refers_to", "error"))
    asked = own.where("refers_to is not null").select("refers_to", "payload_digest").distinct()
    seen = own.where("record_type = 'response' and own is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("own").alias("seen"))
    to = checkpoint(seen.join(asked, ["refers_to", "payload_digest"], "left_semi").groupBy("refers_to", "payload_digest").agg(F.max("seen").alias("seen")))
    out = own.join(small(to), ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("own", "seen").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "error")
