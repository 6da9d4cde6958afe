"""WARC archives: writing segmented records, and reassembling them on the way back.

Archives are WARC/1.1 files, one gzip member per record, written by Spark's own text writer, so they go
to any file system Spark reaches and survive lost executors by its commit protocol.  (A row is a
record's member as it is; the writer's line separator is an empty member.)  A payload travels as an
HTTP response in chunked transfer framing.  A block longer than the segment size is cut: the first
record carries ``WARC-Segment-Number: 1``, continuation records the origin's identifier and their
number, and the last one the total length.  Reading goes through all members of a file, groups
continuation records by origin identifier, orders them by number, verifies the total length, decodes
the chunked framing and verifies the digest.  What a revisit says of its payload is taken from the record
that it refers to.

Defined cases: null html is an empty payload, null url an empty target; a null page_id is stored
without one; a payload of ``REVISIT_BYTES`` bytes or more that several rows share is stored with the
largest page_id, and the other rows refer to it; rows that repeat this page_id are stored in full, and
so are all rows of a payload of which no page_id is known; repeated rows are records of their own, with
identifiers numbered; an empty table gives no records; other columns of ``pages`` are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import attach, materialize, scratch_path, slices

#: Bytes of a block in one segment, bytes in one transfer chunk, records in one file.
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 512
#: Payloads of fewer bytes never become revisits.
REVISIT_BYTES = 1000
#: When the records say they were made, so that one input gives one archive.
DATE = "2024-01-01T00:00:00Z"

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OWN_ID = re.compile(r"<urn:page:(-?\d*):")


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> bytes:
    """What all gzip members of a file hold; a file that is not compressed is taken as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        unpacker = zlib.decompressobj(31)
        out.append(unpacker.decompress(data))
        if not unpacker.eof:
            raise ValueError("a gzip member is cut short")
        data = unpacker.unused_data
    if out and data.strip(b"\0"):
        raise ValueError("something other than a gzip member follows one")
    return b"".join(out) if out else data


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked framing."""
    pieces = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in pieces) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def segments(headers: list[tuple[str, str]], record_id: str, block: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record, or its segments if the block has more than ``size`` bytes."""
    if len(block) <= size:
        yield record(headers, block)
        return
    pieces = [block[i : i + size] for i in range(0, len(block), size)]
    yield record([*headers, ("WARC-Segment-Number", "1")], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}:segment-{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(n))]
        if n == len(pieces):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(more, piece)


def clean(value: str) -> str:
    """A header value on one line."""
    return "".join(" " if ord(c) < 32 else c for c in value)


def record_id(page_id: Column, digest: Column, url_hash: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(":"), F.hex(url_hash), F.lit(":"), copy.cast("string"), F.lit(">"))


def plan_records(pages: DataFrame) -> DataFrame:
    """url, html, digest, id (of the record), refers_to (the id of another) of each page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("url_hash", F.xxhash64("url"))
    # One row per repeated payload: the counting is partial before the exchange, whatever the group's size.
    keys = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest", "url_hash")
    shared = keys.groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url_hash"))).alias("winner"), F.count("*").alias("n"))
    shared = materialize(shared.where("n > 1 AND winner IS NOT NULL"), "warc-shared")
    found = attach(rows, shared, "digest", pages.count())
    # Equal rows, which are together after the exchange, are numbered.
    equal = Window.partitionBy("digest", "__salt", "page_id", "url").orderBy(F.lit(0))
    found = found.withColumn("copy", F.row_number().over(equal))
    winner = F.when(~F.col("page_id").eqNullSafe(F.col("winner.page_id")), record_id(F.col("winner.page_id"), F.col("digest"), F.col("winner.url_hash"), F.lit(1)))
    return found.select("url", "html", "digest", record_id(F.col("page_id"), F.col("digest"), F.col("url_hash"), F.col("copy")).alias("id"), winner.alias("refers_to"))


def write_archive(pages: DataFrame, path: str) -> None:
    """One WARC record (or its segments) per row of ``pages`` (page_id, url, html)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, 1, 4 << 20):
                out = []
                for url, html, digest, identifier, refers in zip(*(c.to_pylist() for c in batch.slice(lo, hi - lo).columns)):
                    headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", identifier), ("WARC-Target-URI", clean(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                    if refers is None:
                        block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(html.encode())
                    else:
                        headers += [("WARC-Refers-To", refers), ("WARC-Profile", PROFILE)]
                        block = HTTP_HEAD + b"\r\n"
                    out.extend(map(gzip_member, segments(headers, identifier, block)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = plan_records(pages).mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    separator = gzip_member(b"").decode("latin-1")
    records.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        if start + size > len(data):
            raise ValueError("a record is cut short")
        yield headers, data[start : start + size]
        at = start + size + 4


def decode_block(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body


def page_of(identifier: str) -> int | None:
    """The page_id in an identifier of our own; None in others."""
    own = OWN_ID.match(identifier)
    return int(own[1]) if own and own[1] else None


def stated_digest(value: str) -> str | None:
    """The SHA-1 that a header states, in hex; it may be in base 32."""
    kind, _, digest = value.partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(digest.upper()).hex() if len(digest) == 32 else digest.lower()


def digested(block: bytes, stated: str | None) -> tuple[int, str]:
    """Payload length and SHA-1; a payload must have the digest that its record states."""
    payload = decode_block(block)
    found = hashlib.sha1(payload).hexdigest()
    if stated and found != stated:
        raise ValueError("a payload does not have the digest of its record")
    return len(payload), found


#: What reading makes of a record; block is there only for records in segments, payload only for responses.
RAW = "id string, segment int, total bigint, type string, refers_to string, digest string, payload_bytes bigint, payload_digest string, block binary"
RAW_SCHEMA = pa.schema([("id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
READ = "id string, type string, refers_to string, digest string, payload_bytes bigint, payload_digest string"
READ_SCHEMA = pa.schema([RAW_SCHEMA.field(c) for c in ("id", "type", "refers_to", "digest", "payload_bytes", "payload_digest")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every response, revisit and continuation of the archives in a folder; whole responses are decoded
    at once, segments keep their block under the origin's id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_records(members(content.as_py())):
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    number = int(h.get("warc-segment-number", 0))
                    stated = stated_digest(h.get("warc-payload-digest", ""))
                    size, sha = digested(block, stated) if kind == "response" and not number else (None, None)
                    total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                    rows.append((h.get("warc-segment-origin-id") or h["warc-record-id"], number, total, kind, h.get("warc-refers-to"), stated, size, sha, block if number else None))
                columns = list(zip(*rows)) or [[]] * len(RAW_SCHEMA)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RAW_SCHEMA)], schema=RAW_SCHEMA)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, RAW)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: id, type, refers_to, digest, payload_bytes, payload_digest.

    Raises ValueError if a segment is missing, the total length is not met or a digest is wrong.
    Whole records pass straight through; only segments are exchanged, by origin.
    """
    names = READ_SCHEMA.names
    whole = records.where("segment = 0").select(*names)

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        first, block = rows[0], b"".join(r["block"] for r in rows)
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(block):
            raise ValueError(f"segments of {first['id']} are missing or don't have the stated length")
        size, sha = digested(block, first["digest"])
        return pa.Table.from_pylist([first | {"payload_bytes": size, "payload_digest": sha}], schema=READ_SCHEMA)

    parts = records.where("segment > 0").select(*names, "segment", "total", "block")
    return whole.unionByName(parts.groupBy("id").applyInArrow(join, READ))


def resolve(stored: DataFrame) -> DataFrame:
    """``stored`` (see ``reassemble``) with each revisit's payload_bytes and payload_digest from the record
    that it refers to.  Raises an error if there is none, or if the digest that the revisit states differs.
    """
    responses, revisits = stored.where("type = 'response'"), stored.where("type = 'revisit'").drop("payload_bytes", "payload_digest")
    targets = responses.select(F.col("id").alias("refers_to"), "payload_bytes", "payload_digest")
    targets = targets.join(revisits.groupBy("refers_to").agg(F.count("*").alias("n")), "refers_to")
    found = attach(revisits, targets, "refers_to", stored.count()).drop("__salt")
    checked = F.when(F.coalesce("digest", "payload_digest") == F.col("payload_digest"), F.col("payload_digest"))
    broken = F.raise_error(F.concat(F.lit("a revisit names no record that has its payload: "), F.col("id")))
    return responses.unionByName(found.withColumn("payload_digest", F.coalesce(checked, broken.cast("string"))))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to; one row per input row.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    stored = resolve(materialize(reassemble(read_records(pages.sparkSession, path)), "warc-read"))
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*):', 1), '') AS bigint)")
    return stored.select(page("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
