"""WARC archives of web pages: a writer with chunked transfer framing, segmented records and revisit records, and a reader that reassembles segments.

Long records are cut into a first segment and continuation records. The reader groups segments by the identifier of the record they began with, orders
them by segment number, verifies numbers and total length, and decodes the chunked framing. Archives are files of bounded size in a folder that all executors
share; Spark's own writers and readers move the bytes."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
#: bytes of a record's block before it is cut; of an archive before the next begins; of a transfer chunk
SEGMENT, ARCHIVE, CHUNK = 1 << 16, 16 << 20, 1 << 13
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Undo `chunked`; chunk extensions and trailers are skipped, broken framing raises ValueError."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line is missing")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in [*fields, ("Content-Length", len(block))] if v is not None]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def page_records(page: object, row: int, url: str | None, payload: bytes, refers: object, revisit: bool, segment: int) -> Iterator[bytes]:
    """The records of one page, without the two line ends after each."""
    digest = digest32(payload)
    identity = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{row}/{digest}')}>"
    target = "".join(c if c.isascii() and c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")
    common = [("WARC-Record-ID", identity), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page)]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        yield _record([("WARC-Type", "revisit"), *common, profile, ("X-Refers-To-Page", refers), ("Content-Type", "application/http; msgtype=response")], block)
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    number = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
    yield _record([("WARC-Type", "response"), *common, number, ("Content-Type", "application/http; msgtype=response")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{identity}/{n}')}>"
        total = len(block) if n == len(parts) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", target)]
        yield _record([*fields, ("WARC-Segment-Origin-ID", identity), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, archive: int = ARCHIVE, id_column: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each page under path, as gzip files of about `archive` bytes of records.

    Of records with equal payloads of at least `least` bytes that with the largest page id is a response (all of its rows, if that page repeats), the others
    revisit it. Null html is an empty payload; a null id sorts below all others; an empty table writes an empty folder."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("page"), F.monotonically_increasing_id().alias("row"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # decided on slim rows: an empty or error page may be the payload of a third of the table, so payloads do not meet by digest
    slim = rows.where(F.octet_length("payload") >= least).select("page", "digest").distinct()
    largest = slim.groupBy("digest").agg(F.max("page").alias("largest"))
    verdicts = slim.join(largest, "digest").where(F.col("largest").isNotNull() & ~F.col("page").eqNullSafe(F.col("largest")))
    verdicts = verdicts.select(F.col("page").alias("_page"), F.col("digest").alias("_digest"), "largest")
    same = F.col("page").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    known = rows.join(verdicts, same, "left").select("page", "row", "url", "payload", "largest", F.col("largest").isNotNull().alias("revisit"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for page, row, url_, payload_, largest_, revisit in zip(*columns):
                for record in page_records(page, row, url_, payload_, largest_, revisit, segment):
                    held.append(record)
                    size += len(record)
                    if size >= archive:
                        yield pa.record_batch({"value": pa.array([b"\r\n\r\n".join(held)], pa.binary())})
                        held, size = [], 0
        if held:
            yield pa.record_batch({"value": pa.array([b"\r\n\r\n".join(held)], pa.binary())})

    packed = known.mapInArrow(pack, "value binary")
    # each row is an archive; the line separator is what ends its last record
    options = {"lineSep": "\r\n\r\n", "maxRecordsPerFile": 1, "compression": "gzip"}
    packed.select(F.col("value").cast("string").alias("value")).write.options(**options).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record, by Content-Length."""
    at = 0
    while at < len(archive):
        head = archive.find(b"\r\n\r\n", at)
        lines = archive[at:head].split(b"\r\n")
        if head < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        end = head + 4 + int(fields["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's block does not end at byte {end}")
        yield fields, archive[head + 4 : end]
        at = end + 4


def unzipped(raw: bytes) -> bytes:
    """A plain or gzip archive as it was; archives may have a gzip member for each record, one in all, or several files behind one another."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        raw = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


_READ = "record_id string, record_type string, page_id long, refers_to long, declared string, origin string, number int, total long, payload_bytes long, payload_digest string, payload binary, block binary"


def _decoded(block: bytes, with_payload: bool) -> tuple:
    payload = http_payload(block)
    return len(payload), digest32(payload), payload if with_payload else None


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record; whole records come decoded, segments with their block. Archives are gzip or plain, and each fits a task's memory."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, types[x.split(" ")[1]]) for n, x in zip(names, _READ.split(", "))])

    def row(fields: dict[str, str], block: bytes) -> tuple:
        get = fields.get
        number = int(get("warc-segment-number")) if get("warc-segment-number") else None
        kind = get("warc-type")
        declared = (get("warc-payload-digest") or "").removeprefix("sha1:") or None
        head = (get("warc-record-id"), kind, *[int(v) if (v := get(k)) not in (None, "None") else None for k in ("x-page-id", "x-refers-to-page")], declared)
        segment = (get("warc-segment-origin-id") or (get("warc-record-id") if number else None), number, int(get("warc-segment-total-length")) if get("warc-segment-total-length") else None)
        if number:
            return (*head, *segment, None, None, None, block)
        if kind == "revisit":
            return (*head, *segment, int(re.search(rb"(?im)^content-length:\s*(\d+)", block)[1]), declared, None, None)
        return (*head, *segment, *_decoded(block, with_payload), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = unzipped(content.as_py())
                rows, size = [], 0
                for fields, block in parse(raw):
                    rows.append(row(fields, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.mapInArrow(run, _READ)


def reassemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Segmented records of `read_records` as whole ones: grouped by origin, ordered by number; numbers must run from 1 without a gap or repeat, and the
    blocks' lengths must sum to the total that the last one names, else ValueError. Whole records pass through."""
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    parts = records.where("number IS NOT NULL")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        numbers, totals = table.column("number").to_pylist(), table.column("total").to_pylist()
        block = b"".join(table.column("block").to_pylist())
        if numbers != list(range(1, len(numbers) + 1)) or totals[-1] != len(block):
            raise ValueError(f"segments of {key[0].as_py()}: numbers {numbers[:20]}, {len(block)} bytes of {totals[-1]}")
        size, digest, payload = _decoded(block, with_payload)
        first = table.slice(0, 1)
        values = {"payload_bytes": size, "payload_digest": digest, "payload": payload, "block": None, "number": None, "total": None, "origin": None}
        return pa.table([pa.array([values[n]], first.schema.field(n).type) if n in values else first.column(n) for n in names], names=names)

    return records.where("number IS NULL").unionByName(parts.groupBy("origin").applyInArrow(join, _READ))
