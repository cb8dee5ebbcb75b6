"""Legacy archives: write and parse ARC files, convert them to WARC, read WARC back.

ARC 1 and ARC 2 name their fields in the version block at a file's start; a
record is one header line, whose last field declares the length of what
follows.  The converter parses each file by the fields of its own version and
by the declared lengths, never by looking for marks inside a payload, and
synthesises what WARC asks for and ARC lacks: record ids (UUID 5 of the
record's origin), dates, types and digests.

Spark writes and reads all files, so any file system will do: the text sink
puts a record's end mark after every row (``lineSep``), and readers take whole
files (``binaryFile``) of bounded size.  Files are gzip streams of several
records.

Payloads at least ``MIN_REVISIT`` bytes long that occur more than once are kept
once: the record with the smallest page id is the response, the others are
revisits that refer to it.  Digests are aggregated to their smallest page id
before the join, and only digests that occur twice take part in it.

Null payload is an empty payload, null URL becomes ``urn:page:<id>``; white
space and control characters in URLs are percent-encoded.  A null page id is
kept as null.  Rows that repeat the smallest page id are all responses.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare_workers, scratch_path

MIN_REVISIT = 100
ARC_DATE = "20260101000000"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
# Field names of the two ARC versions, as their version blocks list them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
EMPTY = hashlib.sha256(b"").hexdigest()


def _url(url: str | None, page_id) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else f"urn:page:{page_id}"


def _gzip_fast(writer):
    return writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One ARC file per partition, versions 1 and 2 in turn; the page id travels in an HTTP header."""
    prepare_workers(pages.sparkSession)
    d = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        offset, first = 0, True
        for batch in batches:
            out = []
            if first:
                body = f"{version} 0 tabwright\n{ARC_FIELDS[version]}\n".encode()
                line = f"filedesc://part-{part}.arc 0.0.0.0 {ARC_DATE} text/plain" + (" 200 - - 0 -" if version == 2 else "")
                out.append(f"{line} {len(body)}\n".encode() + body)
                offset, first = len(out[0]) + 1, False
            for page_id, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                size = len(head) + len(payload)
                line = f"{_url(url, page_id)} 0.0.0.0 {ARC_DATE} text/html" + (f" 200 {zlib.crc32(payload):08x} - {offset} part-{part}.arc" if version == 2 else "")
                out.append(b"".join((f"{line} {size}\n".encode(), head, payload)))
                offset += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    _gzip_fast(d.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
               .write.option("lineSep", "\n")).text(path)


class Stream:
    """Reads a gzip (or plain) file held in memory, piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buf = data, 0, bytearray()
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = self.data[self.at:self.at + (1 << 18)]
        self.at += len(chunk)
        while self.gz and chunk:
            self.buf += self.gz.decompress(chunk)
            chunk = self.gz.unused_data
            if self.gz.eof:                       # the next member of the file
                self.gz = zlib.decompressobj(31)
        if not self.gz:
            self.buf += chunk
        return True

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        if len(self.buf) < n:
            raise ValueError(f"archive ends within a record: {n} bytes declared, {len(self.buf)} left")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def line(self, end: bytes = b"\n") -> bytes | None:
        """Up to and without ``end``; None at the end of the file."""
        seen = 0
        while (at := self.buf.find(end, seen)) < 0:
            seen = max(0, len(self.buf) - len(end))
            if not self._more():
                if not self.buf:
                    return None
                at = len(self.buf)
                break
        out = bytes(self.buf[:at])
        del self.buf[:at + len(end)]
        return out


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: the header fields by their names, ``offset`` and ``body``."""
    s = Stream(data)
    first = s.line()
    if first is None:
        return
    if not first.startswith(b"filedesc://"):
        raise ValueError("an ARC file starts with its version block")
    block = s.take(int(first.rsplit(b" ", 1)[1])).decode("utf-8", "surrogateescape").split("\n")
    version, names = int(block[0].split(" ")[0]), block[1].split(" ")
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version}")
    while (line := s.line()) is not None:
        if not line:                              # what separates records
            continue
        values = line.decode("utf-8", "surrogateescape").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"ARC {version} header with {len(values)} fields: {line[:200]!r}")
        rec = dict(zip(names, values))
        rec["body"] = s.take(int(rec["Archive-length"]))
        yield rec


def _http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload."""
    at = body.find(b"\r\n\r\n")
    return (body[:at + 4], body[at + 4:]) if body.startswith(b"HTTP/") and at >= 0 else (b"", body)


def _header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return m.group(1).decode("utf-8", "surrogateescape") if m else None


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, ip, date (ISO), mime, head, bytes, squeezed (the payload under zstd, as it travels
    between tasks), payload_digest and place (file and number) of all records under ``path``."""
    prepare_workers(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:5]), pa.array(cols[5], pa.binary()),
                 pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.binary()), pa.array(cols[8], pa.string()), pa.array(cols[9], pa.string())],
                names=["page_id", "url", "ip", "date", "mime", "head", "bytes", "squeezed", "payload_digest", "place"])

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size, name = [], 0, batch.column(1)[i].as_py()
                for k, rec in enumerate(parse_arc(batch.column(0)[i].as_py())):
                    head, payload = _http(rec["body"])
                    page = _header(head, b"X-Page-Id")
                    d = rec["Archive-date"].ljust(14, "0")
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rows.append((int(page) if page else None, rec["URL"], rec["IP-address"], date, rec["Content-type"], head, len(payload), squeeze(payload), hashlib.sha256(payload).hexdigest(), f"{name} {k}"))
                    size += len(rows[-1][7]) + 500
                    if size > 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").load(path).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.mapInArrow(parse, "page_id long, url string, ip string, date string, mime string, head binary, bytes long, squeezed binary, payload_digest string, place string")


def squeeze(payload: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(payload)


def expand(squeezed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(squeezed)


def record_id(place: str, date: str, url: str) -> str:
    """From where the record lies in its archive: equal records get ids of their own, the same one the same again."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{place} {date} {url}')}>"


def convert(records: DataFrame, path: str) -> None:
    """Write records of ``read_arc`` as WARC 1.1 under ``path``."""
    digests = (records.where(F.col("bytes") >= MIN_REVISIT)
               .groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place", "date", "url"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
               .where("_n > 1 AND _first IS NOT NULL")
               .select(F.col("payload_digest").alias("_digest"), "_first", F.col("_first.page_id").alias("_least")))
    own = records.join(digests, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_least"))
    rows = own.select("page_id", "place", "url", "ip", "date", "head", "bytes",
                      F.when(~revisit, F.col("squeezed")).alias("squeezed"), "payload_digest", F.when(revisit, F.col("_first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = True
        for batch in batches:
            out = []
            if first:
                info = b"software: tabwright\r\nformat: WARC File Format 1.1\r\n"
                part = TaskContext.get().partitionId()
                out.append(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {batch.column('date')[0]}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'{path} {part}')}>\r\n"
                           f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info)
                first = False
            for page_id, place, url, ip, date, head, size, squeezed, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if refers is None else "revisit"
                block = head + (expand(squeezed) if squeezed else b"")
                lines = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id(place, date, url)}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\n"
                         f"WARC-IP-Address: {ip}\r\nWARC-Payload-Digest: sha256:{digest}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\n"]
                if refers is not None:
                    lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                                 f"WARC-Refers-To: {record_id(refers['place'], refers['date'], refers['url'])}\r\nWARC-Refers-To-Target-URI: {refers['url']}\r\n"
                                 f"WARC-Refers-To-Date: {refers['date']}\r\nX-Refers-To-Page-Id: {refers['page_id']}\r\nX-Payload-Length: {size}\r\n")
                lines.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
                out.append("".join(lines).encode("utf-8", "surrogateescape") + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    _gzip_fast(rows.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
               .write.option("lineSep", "\r\n\r\n")).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record, by the declared lengths."""
    s = Stream(data)
    while (head := s.line(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:80]!r}")
        length = _header(head, b"Content-Length")
        yield head + b"\r\n", s.take(int(length))
        s.take(4)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_record[, payload] of the
    responses and revisits under ``path``.  Digests of responses are computed anew and must
    equal the declared ones."""
    prepare_workers(spark)
    types = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string())] + ([("payload", pa.binary())] if payloads else [])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for head, block in parse_warc(batch.column(0)[i].as_py()):
                    kind = _header(head, b"WARC-Type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = _http(block)
                    page, digest = _header(http, b"X-Page-Id"), _header(head, b"WARC-Payload-Digest").removeprefix("sha256:")
                    refers = _header(head, b"X-Refers-To-Page-Id")
                    n = int(_header(head, b"X-Payload-Length") or 0) if kind == "revisit" else len(payload)
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {_header(head, b'WARC-Record-ID')} does not have its declared digest")
                    rows.append((int(page) if page else None, n, digest, kind, int(refers) if refers else None, _header(head, b"WARC-Record-ID"), _header(head, b"WARC-Refers-To"), *([payload] if payloads else [])))
                    size += 200 + len(payload) * payloads
                    if size > 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string" + (", payload binary" if payloads else "")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """pages -> ARC files -> WARC files -> rows of ``read_warc``."""
    spark = pages.sparkSession
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, payload_col)
    convert(read_arc(spark, arc), out)
    return read_warc(spark, out)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND least IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND least IS DISTINCT FROM page_id THEN least END AS refers_to
FROM m
"""
