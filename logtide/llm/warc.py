"""WARC archives: writing pages as records, and reassembling segmented records.

Writing.  A page becomes a ``response`` record whose block is an HTTP response in
chunked transfer framing, or, if its payload of at least ``MIN_REVISIT`` bytes
equals that of a page with a greater id, a ``revisit`` that refers to the page
with the greatest id.  A block longer than ``segment_bytes`` is cut into a first
segment and ``continuation`` records.  Records go to gzip-compressed files through
Spark's text writer with the record terminator as line separator, so any file
system that Spark can write to will do.  Payloads are not shuffled by their digest
while the repeated digests are few enough to broadcast; beyond that, the digests of
large groups are still broadcast, and only the rest are shuffled.

Reading.  Lines come back in file order, so a record's block is as many of them as
its Content-Length says, whatever the payload contains.  Whole records are decoded
where they are read.  Segments are grouped by origin identifier, ordered by
segment number, checked to be consecutive and to add up to the total length that
the last one states, joined and freed of the chunked framing; the payload's
digest is checked against the header.  A record that fails a check raises
``ValueError``.

Defined results: null html is the empty payload, null url leaves out the target;
rows with equal id and payload become records with equal identifiers, their
segments are collapsed when read and the page comes out as often as it went in;
of pages with the greatest id and equal payload all are responses; null ids rank
lowest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import folder, join_by_count, table

MIN_REVISIT = 1000
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 4_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Bytes of records in one output batch.
BATCH_BYTES = 8_000_000

_RECORD = "type string, record_id string, origin string, segment int, total long, page_id string, digest string, refers_to string, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}|{digest}'.encode()).hexdigest())}>"


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def segments(block: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes.  None but the last ends in a line break, which would run into the record terminator and blur the boundary."""
    out, at = [], 0
    while at < len(block):
        end = at + size
        while end < len(block) and block[end - 1 : end] in (b"\r", b"\n"):
            end += 1
        out.append(block[at:end])
        at = end
    return out


def records(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page."""
    own = record_id(page_id, digest)
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", _base32(digest))]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", refers_to)]
        return [_record(fields, b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    pieces = segments(block, segment_bytes)
    if len(pieces) == 1:  # what is beyond the limit is line breaks, which stay with the piece before them
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{own}#{n}", digest)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n)]
        if n == len(pieces):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(fields, piece))
    return out


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write an archive of ``pages`` (page_id, url, html) at ``path``."""
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    same = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    joined = join_by_count(rows, table(same.where("n > 1").drop("n"), "warc-same"), "digest")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    joined = joined.select(F.col("page_id").cast("string"), "url", F.when(~revisit, F.col("html")).alias("html"), "digest", F.when(revisit, F.col("response").cast("string")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5))):
                page_id, url, text, digest, refers_to = (x.as_py() for x in row)
                new = records(page_id, url, (text or "").encode(), digest, refers_to, segment_bytes, chunk_bytes)
                out += new
                size += sum(map(len, new))
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not the start of a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _blocks(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, from the lines between record terminators."""
    head, parts, have, need = None, [], 0, 0
    for line in lines:
        if head is None:
            head, parts = _headers(line), []
            have, need = -len(END), int(head["content-length"])
            continue
        parts.append(line)
        have += len(END) + len(line)
        if have > need:
            raise ValueError("record longer than its Content-Length")
        if have == need:
            yield head, END.encode().join(parts)
            head = None
    if head is not None:
        raise ValueError("record shorter than its Content-Length")


def _checked(block: bytes, digest: str) -> int:
    payload = payload_of(block)
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload differs from its digest")
    return len(payload)


def _digest(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_RECORD``; a whole response has its payload's length as total and no block."""
    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    rows, size = [], 0
    for head, block in _blocks(x.as_py() for b in batches for x in b.column(0)):
        kind, number = head["warc-type"], int(head.get("warc-segment-number", 0))
        page = head.get("warc-page-id")
        total = int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None
        digest = _digest(head["warc-payload-digest"]) if "warc-payload-digest" in head else None
        if kind == "response" and not number:
            total, block = _checked(block, digest), None
        rows.append((kind, head["warc-record-id"], head.get("warc-segment-origin-id", head["warc-record-id"]), number, total, page, digest, head.get("warc-refers-to-page-id"), block))
        size += 300 + len(block or b"")
        if size >= BATCH_BYTES:
            yield batch_of(rows)
            rows, size = [], 0
    yield batch_of(rows)


_PAGE = "page_id string, digest string, type string, refers_to string, copies int, payload_bytes long"


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload lengths: those of whole records as read, those of segmented ones from their ordered segments."""
    for b in batches:
        lengths = []
        for digest, segments in zip(b.column(1).to_pylist(), b.column(5)):
            segments = segments.as_py()
            if segments[0]["segment"] == 0:
                lengths.append(segments[0]["total"])
                continue
            if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                raise ValueError("segments are missing or repeated with other content")
            block = b"".join(s["block"] for s in segments)
            if segments[-1]["total"] != len(block):
                raise ValueError("segments do not add up to the total length")
            lengths.append(_checked(block, digest))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(lengths, pa.int64())], [x.split()[0] for x in _PAGE.split(", ")])


def read(spark, path: str, page_type: str = "bigint") -> DataFrame:
    """One row per page of the archive at ``path``.  Revisits take their length from the response they share a digest with."""
    lines = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"))
    rows = lines.mapInArrow(_parse, _RECORD)
    by_origin = rows.groupBy("origin").agg(
        F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"),
        F.min(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"),
        F.max("refers_to").alias("refers_to"),
        F.count_if(F.col("segment") <= 1).cast("int").alias("copies"),
        F.sort_array(F.collect_set(F.struct("segment", "total", "block"))).alias("segments"),
    )
    pages = table(by_origin.drop("origin").mapInArrow(_join, _PAGE), "warc-pages")
    pages = pages.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    responses = pages.where("type = 'response'")
    revisits = pages.where("type = 'revisit'").drop("payload_bytes")
    wanted = revisits.select("digest").distinct()
    sizes = responses.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = join_by_count(revisits, table(sizes, "warc-sizes"), "digest")
    every = responses.unionByName(revisits.select(*responses.columns))
    return every.select(
        F.col("page_id").cast(page_type).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(page_type).alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archive back."""
    spark = pages.sparkSession
    path = folder(spark, "warc")
    write(pages, path)
    return read(spark, path, pages.schema["page_id"].dataType.simpleString())
