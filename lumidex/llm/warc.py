"""WARC archives: write, revisit, segment, read back and reassemble (operator 2).

Writing: each page becomes a WARC/1.1 record. Its HTTP block uses chunked transfer
framing and is cut into segments of at most SEGMENT_BYTES: a response record with
WARC-Segment-Number 1 and continuation records that name it in
WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. Among pages with
equal payloads of at least REVISIT_BYTES the smallest page_id is the response and the
others are revisit records (identical-payload-digest profile) without a body that name its
address, date and page_id. Each record is a gzip member of its own, so that a reader can
begin at any of them.

Reading: archives are read as files, records parsed by their Content-Length,
continuation records grouped by origin identifier, ordered by segment number, checked
for gaps and against the total length, joined, and the chunked framing decoded.

Scale: nothing is gathered but the segments of one record. The smallest page of a
payload comes from an aggregation with map-side combine, which is written before pages
join it: right above its two exchanges adaptive execution may split a hot payload.
Records without continuation never shuffle on the way back. Archive files roll over
at RECORDS_PER_FILE records, so a file has at most about RECORDS_PER_FILE *
SEGMENT_BYTES. Lost executors: the writer is Spark's own committed file output.

Defined results: null html is an empty payload; null url becomes an empty target; a
null page_id is written as such and comes back null; rows that repeat exactly come
back as often as they went in (their equal page_id: one of them is the response, and
all rows with that page_id are, for a revisit must name another page). An empty table
gives no rows. Segments that are missing or of the wrong total length raise an error:
an archive that just was written has to be whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import saved, shared_path, table

REVISIT_BYTES = 100
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
RECORDS_PER_FILE = 1000
MEMBER_BYTES = 1 << 24
STEP_BYTES = 1 << 12
CRLF = b"\r\n"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """body in HTTP/1.1 chunked transfer framing."""
    out = []
    for at in range(0, len(body), size):
        piece = body[at : at + size]
        out += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are allowed. Raises ValueError when it ends early."""
    out, at = [], 0
    while True:
        line_end = framed.find(CRLF, at)
        if line_end < 0:
            raise ValueError("chunked body ends before its last chunk")
        size = int(framed[at:line_end].split(b";")[0].strip(), 16)
        at = line_end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is shorter than its size says")
        out.append(framed[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + CRLF + CRLF


def members(record: bytes) -> Iterator[bytes]:
    """record as gzip members, one below MEMBER_BYTES, each without its last byte.

    That byte, the highest of the member's length, is zero: the file writer puts it there as
    the separator of its lines.
    """
    for at in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield (packer.compress(record[at : at + MEMBER_BYTES]) + packer.flush())[:-1]


def inflated(content: bytes) -> bytes:
    """All members of a gzip file; what follows a member is looked at in small steps, so that time stays linear."""
    out, at, left, view = [], 0, b"", memoryview(content)
    reader = zlib.decompressobj(31)
    while at < len(view) or left:
        piece = left or view[at : at + STEP_BYTES]
        at += 0 if left else len(piece)
        out.append(reader.decompress(piece))
        left = reader.unused_data
        if reader.eof:
            reader = zlib.decompressobj(31)
    return b"".join(out)


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def page_records(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, first_url: str | None, run: str, serial: str) -> Iterator[bytes]:
    """The WARC records of one page; of a revisit with the page_id and address that it refers to."""
    ident = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{serial}')}>"
    body = (html or "").encode("utf-8", "surrogatepass")
    base = [
        ("WARC-Record-ID", ident),
        ("WARC-Target-URI", _target(url)),
        ("WARC-Date", "2026-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        first = [("WARC-Refers-To-Target-URI", _target(first_url)), ("WARC-Refers-To-Date", base[2][1]), ("X-Refers-To-Page-ID", str(refers_to))]
        yield _record([("WARC-Type", "revisit"), *base, ("WARC-Profile", profile), *first, ("Content-Type", "application/http; msgtype=response")], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
    parts = [block[at : at + SEGMENT_BYTES] for at in range(0, len(block), SEGMENT_BYTES)]
    number = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    yield _record([("WARC-Type", "response"), *base, *number, ("Content-Type", "application/http; msgtype=response")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{serial}/{n}')}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", base[2][1]), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(n)), *total], part)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive's bytes."""
    at, end = 0, len(data)
    while at < end:
        if data.startswith(CRLF, at):
            at += 2
            continue
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:head_end].decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = head_end + 4 + int(headers["content-length"])
        if at > end:
            raise ValueError("record is cut short")
        yield headers, data[head_end + 4 : at]


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response of its own) and first_url, the address that it refers to."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sized = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"), (F.octet_length(body) >= REVISIT_BYTES).alias("large"))
    first = sized.where("large").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    first = saved(first.select(F.col("digest").alias("first_digest"), "first_id", "first_url"), "first")
    joined = sized.join(first, F.col("large") & (F.col("digest") == F.col("first_digest")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"), "first_url")


def write_archives(pages: DataFrame, path: str) -> None:
    """WARC files of all pages under path, each record a gzip member."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task that runs again draws new identifiers, and only one run's file is committed
        run, serial = uuid.uuid4().hex, 0
        for pdf in frames:
            out: list[bytes] = []
            held = 0
            for page_id, url, html, digest, refers_to, first_url in pdf.itertuples(index=False):
                serial += 1
                for rec in page_records(None if pd.isna(page_id) else int(page_id), url, html, digest, None if pd.isna(refers_to) else int(refers_to), first_url, run, str(serial)):
                    for member in members(rec):
                        out.append(member)
                        held += len(member)
                if held > 8 << 20:
                    yield pd.DataFrame({"record": out})
                    out, held = [], 0
            yield pd.DataFrame({"record": out})

    records = with_revisits(pages).mapInPandas(build, "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    )


PART = "page_id long, url string, type string, refers_to long, digest string, ident string, origin string, number int, total long, block binary"


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PART.split(", ")]
    for pdf in frames:
        for content in pdf["content"]:
            rows, held = [], 0
            for h, block in parse_records(inflated(content)):
                if h["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                as_int = lambda k, h=h: int(h[k]) if h.get(k) else None
                rows.append((as_int("x-page-id"), h.get("warc-target-uri"), h["warc-type"], as_int("x-refers-to-page-id"), h.get("warc-payload-digest", "").removeprefix("sha256:"), h["warc-record-id"], h.get("warc-segment-origin-id", h["warc-record-id"]), as_int("warc-segment-number") or 0, as_int("warc-segment-total-length"), block))
                held += len(block)
                if held > 8 << 20:
                    yield _typed(rows, names)
                    rows, held = [], 0
            yield _typed(rows, names)


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "number": "int32", "total": "Int64"})


PAGE = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records to payloads; a digest that does not hold raises."""
    for pdf in frames:
        rows = []
        for page_id, url, kind, refers_to, digest, block in pdf[["page_id", "url", "type", "refers_to", "digest", "block"]].itertuples(index=False):
            head, _, body = bytes(block).partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
            if kind == "revisit":
                rows.append((page_id, url, None, int(fields[b"content-length"]), digest, kind, refers_to))
                continue
            if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
                body = unchunked(body)
            found = hashlib.sha256(body).hexdigest()
            if digest and found != digest:
                raise ValueError(f"payload digest of page {page_id} does not hold")
            rows.append((page_id, url, body, len(body), found, kind, None))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGE.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def reassembled(parts: DataFrame) -> DataFrame:
    """The records of parts that are not segmented, and those joined from all their segments."""
    whole = parts.where("number = 0").select("page_id", "url", "type", "refers_to", "digest", "block")
    joined = (
        parts.where("number > 0")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("segments"),
            F.max("total").alias("total"),
            *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("page_id", "url", "type", "refers_to", "digest")],
        )
        .withColumn("block", F.unhex(F.array_join(F.transform("segments", lambda s: F.hex(s["block"])), "")))
    )
    in_order = F.transform("segments", lambda s: s["number"].cast("long")) == F.sequence(F.lit(1).cast("long"), F.size("segments").cast("long"))
    sound = F.col("type").isNotNull() & in_order & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("segments of "), F.col("origin"), F.lit(" are incomplete"))).cast("binary")
    return whole.unionByName(joined.select("page_id", "url", "type", "refers_to", "digest", F.when(sound, F.col("block")).otherwise(broken).alias("block")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return reassembled(files.mapInPandas(_parts, PART)).mapInPandas(_decoded, PAGE)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
