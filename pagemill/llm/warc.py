"""WARC archives: writing pages as records, and segment reassembly on reading.

Writing: a page becomes an HTTP response record whose block, if longer than ``SEGMENT_BYTES``, is cut into a first
record and continuations (WARC-Segment-Number, -Origin-ID, and -Total-Length on the last).  Longer payloads use chunked
transfer framing.  Of equal payloads of at least ``REVISIT_BYTES`` that of the largest page_id is written; the others
become revisit records with the payload's digest and no body.  Records go through Spark's own text writer, with CRLF
as separator, so archives lie wherever Spark can write; a file holds at most ``FILE_RECORDS`` records of bounded size.

Reading: each archive file is one binary row, inflated as it is parsed by the records' Content-Length, so that a worker
holds the file as it lies and one record besides.  Records in segments are grouped
by origin, ordered by segment number, and accepted if the numbers are 1..n and the lengths sum to the stated total;
then the HTTP head is taken off and chunked framing decoded.  A revisit gets its payload's size from the response that
it refers to.

Defined results: a null html is an empty payload; a null url is left out; control characters in urls are
percent-encoded; repeated rows make a record each, and equal rows of the largest page_id are all responses; a null
page_id is smaller than any other; a record that fails a check keeps its row, with the reason in problem and no
payload; an empty table makes an archive without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import storage

SEGMENT_BYTES = 16 << 10
FRAME_BYTES = 4 << 10
REVISIT_BYTES = 1000
FILE_RECORDS = 2000
DATE = "2024-01-01T00:00:00Z"  # of capture; the pages table has none


def record(kind: str, block: bytes, **fields: str | int | None) -> bytes:
    """A record without its last CRLF, which the writer adds."""
    head = [("WARC-Type", kind), *((k.replace("_", "-"), v) for k, v in fields.items() if v is not None), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n"


def frame(payload: bytes, size: int = FRAME_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[a : a + size]), payload[a : a + size]) for a in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """Undo chunked framing; extensions and trailers are passed over.  ValueError if it is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        digits = body[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            raise ValueError("chunk size unreadable")
        size, at = int(digits, 16), end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("HTTP head missing")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unframe(body)
    if b"content-length" in fields and int(fields[b"content-length"]) != len(body):
        raise ValueError("body is not as long as stated")
    return body


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    own = f"<urn:uuid:{uuid.uuid4()}>"
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    digest = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    common = {"WARC_Record_ID": own, "WARC_Date": DATE, "WARC_Target_URI": uri, "Page_ID": page_id, "WARC_Payload_Digest": digest, "Content_Type": "application/http; msgtype=response"}
    if refers_to is not None:
        yield record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Refers_To_Page_ID=refers_to, **common)
        return
    chunked = len(payload) > FRAME_BYTES
    size = "Transfer-Encoding: chunked" if chunked else f"Content-Length: {len(payload)}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{size}\r\n\r\n".encode() + (frame(payload) if chunked else payload)
    if len(block) <= segment:
        yield record("response", block, **common)
        return
    n = -(-len(block) // segment)
    yield record("response", block[:segment], WARC_Segment_Number=1, **common)
    for k in range(1, n):
        total = len(block) if k == n - 1 else None
        yield record("continuation", block[k * segment : (k + 1) * segment], WARC_Record_ID=f"<urn:uuid:{uuid.uuid4()}>", WARC_Date=DATE, WARC_Segment_Origin_ID=own, WARC_Segment_Number=k + 1, WARC_Segment_Total_Length=total)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) with digest and refers_to, the page whose record holds the same payload.

    What payloads share is written first: then AQE can split the join of a payload that very many pages have.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    shared = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(storage.written(shared, "shared"), ["digest", "size"], "left")
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """A WARC record, or more in segments, per row of (page_id, url, html)."""
    storage.bound_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
            for a in range(0, len(batch), 200):
                yield pa.record_batch([pa.array([x for page_id, url, html, digest, refers_to in zip(*(c[a : a + 200] for c in columns), strict=True) for x in page_records(page_id, url, html.encode(), digest, refers_to, segment)], pa.binary())], ["value"])

    records = revisits(pages).mapInArrow(run, "value binary").select(F.col("value").cast("string"))  # bytes as they are
    records.write.options(**{"lineSep": "\r\n", "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": FILE_RECORDS}).text(path)


INFLATE_BYTES = 1 << 20


def inflated(raw: bytes) -> Iterator[bytes]:
    """Pieces of bounded size of a plain or gzip file; gzip files may have a member per record."""
    view = memoryview(raw)
    if raw[:2] != b"\x1f\x8b":
        for a in range(0, len(raw), INFLATE_BYTES):
            yield bytes(view[a : a + INFLATE_BYTES])
        return
    at, inflater, rest = 0, zlib.decompressobj(31), b""
    while at < len(raw) or rest:
        if not rest:
            rest, at = bytes(view[at : at + INFLATE_BYTES]), at + INFLATE_BYTES
        if inflater.eof:  # another member, or zeros that fill up a block
            rest = rest.lstrip(b"\0")
            if not rest:
                continue
            inflater = zlib.decompressobj(31)
        piece = inflater.decompress(rest, INFLATE_BYTES)
        rest = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
        if piece:
            yield piece
    if not inflater.eof:
        raise ValueError("archive cut short")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, lower-case keys, and block of every record of a file."""
    pieces, held, done = inflated(data), bytearray(), False

    def more() -> bool:
        nonlocal done
        piece = next(pieces, None)
        done = piece is None
        held.extend(piece or b"")
        return not done

    passed = 0
    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and not done):
            if held[:2] == b"\r\n":
                del held[:2]
                passed += 2
            else:
                more()
        if not held:
            return
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if not held.startswith(b"WARC/") or end < 0:
            raise ValueError(f"no record at byte {passed}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[:end].decode("utf-8", "replace").split("\r\n")[1:])}
        whole = end + 4 + int(fields["content-length"])
        while len(held) < whole and more():
            pass
        if len(held) < whole:
            raise ValueError("archive cut short")
        yield fields, bytes(held[end + 4 : whole])
        del held[:whole]
        passed += whole


RECORDS = "record_id string, kind string, page_id long, url string, digest string, refers_to long, number int, origin_id string, total long, block binary"
WHOLE = "record_id string, kind string, page_id long, url string, digest string, refers_to long, payload binary, problem string"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= 500 or size >= storage.BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def record_row(f: dict[str, str], block: bytes) -> tuple:
    """A parsed record as a row of RECORDS."""
    digest = f.get("warc-payload-digest", "")
    digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    return (f.get("warc-record-id"), f.get("warc-type"), _number(f.get("page-id")), f.get("warc-target-uri"), digest, _number(f.get("refers-to-page-id")), _number(f.get("warc-segment-number")), f.get("warc-segment-origin-id"), _number(f.get("warc-segment-total-length")), block)


def payload_of(kind: str, block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, problem) of a whole record; revisits have neither."""
    if kind != "response":
        return None, None
    try:
        return http_payload(block), None
    except ValueError as e:
        return None, str(e)


def archives(spark, path: str) -> DataFrame:
    """One row per archive file below a path, read by Spark wherever it lies: content."""
    return spark.read.format("binaryFile").load(path).select("content")


def read_records(spark, path: str) -> DataFrame:
    """All records of the archives below a path, segments as they are."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches((record_row(f, block) for f, block in parse_archive(content.as_py())), RECORDS)

    return archives(spark, path).mapInArrow(run, RECORDS)


def joined_segments(segments: DataFrame) -> DataFrame:
    """Records in segments, grouped by origin, ordered by number and verified, as rows of WHOLE."""
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    names = ("kind", "page_id", "url", "digest", "refers_to")
    groups = segments.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(*(first(c) for c in names), F.collect_list(F.struct("number", "total", "block")).alias("parts"))

    def run(batches):
        for batch in batches:
            rows = []
            for *meta, parts in zip(*(batch.column(c).to_pylist() for c in ("record_id", *names, "parts")), strict=True):
                parts = sorted(parts, key=lambda p: p["number"])
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                    rows.append((*meta, None, "segments missing or repeated"))
                elif parts[-1]["total"] != len(block):
                    rows.append((*meta, None, "segments do not sum to the stated length"))
                else:
                    rows.append((*meta, *payload_of(meta[1], block)))
            yield _batch(rows, WHOLE)

    return groups.mapInArrow(run, WHOLE)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records with their payloads: WHOLE.  Only records in segments are shuffled."""
    names = ["record_id", "kind", "page_id", "url", "digest", "refers_to", "block"]

    def run(batches):
        for batch in batches:
            yield _batch([(*meta, *payload_of(meta[1], block)) for *meta, block in zip(*(batch.column(c).to_pylist() for c in names), strict=True)], WHOLE)

    return records.where("number IS NULL").select(*names).mapInArrow(run, WHOLE).unionByName(joined_segments(records.where("number IS NOT NULL")))


def read_pages(spark, path: str) -> DataFrame:
    """One row per page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, problem.

    Archives are parsed once: whole records are digested on the way, segments are kept for joining.
    """
    schema = RECORDS + ", bytes long, sha1 string, problem string"

    def judged(row):
        if row[6] is not None:
            return (*row, None, None, None)
        payload, problem = payload_of(row[1], row[-1])
        return (*row[:-1], None, *((None, None) if payload is None else (len(payload), hashlib.sha1(payload).hexdigest())), problem)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(map(judged, (record_row(f, block) for f, block in parse_archive(content.as_py()))), schema)

    parsed = storage.written(archives(spark, path).mapInArrow(run, schema), "records")
    names = ["kind", "page_id", "url", "digest", "refers_to", "bytes", "sha1", "problem"]
    cut = joined_segments(parsed.where("number IS NOT NULL")).withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    rows = parsed.where("number IS NULL").select(*names).unionByName(cut.select(*names))
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.col("sha1") != F.col("digest"), "payload differs from its digest")))
    rows = storage.written(rows, "pages")
    there = rows.where("kind = 'response' AND problem IS NULL").select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), F.col("bytes").alias("_bytes")).distinct()
    again = rows.where("kind = 'revisit'").join(there, (F.col("refers_to") == F.col("_page")) & (F.col("digest") == F.col("_sha1")), "left")
    again = again.withColumns({"bytes": F.col("_bytes"), "sha1": F.col("_sha1"), "problem": F.when(F.col("_page").isNull(), "response missing")}).drop("_page", "_sha1", "_bytes")
    out = rows.where("kind = 'response'").unionByName(again)
    return out.select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "problem")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM d
"""
