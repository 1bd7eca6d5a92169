"""Legacy ARC archives, their conversion to WARC, and reading both back (operator 7).

Pages are first written as ARC files, in version 1 (5 header fields) and version 2 (10 fields).  The
converter reads them by their own rules: the version block at a file's start names the fields, each
record's header line declares its length, and exactly that many bytes follow.  From a record it
synthesises the WARC identifier (a UUID from the record's place and URL), the WARC date, the type and the
block and payload digests.  Of equal HTTP payloads the record of the largest page id becomes a response,
the others become revisits that refer to it and carry only the HTTP header.  Records of other kinds (the
name lookups of crawlers, bodies without an HTTP status line) become resources of their declared media
type.  Last the WARC files are read back, payload digests recomputed and checked, and references
resolved by record identifier.

Files are written by Spark's text writer (gzip, one archive of about ``ARCHIVE_BYTES`` per file, in the
shared folder) and read by its binary file source, so any file system that Spark knows will do; a
task's memory is bounded by its split of compressed archives and the largest single page.  Only the
narrow index (place, page id, digest) is grouped; payloads are joined by their unique place.

Edge cases: null html is an empty payload; a null URL becomes ``urn:page``, white space and control
characters in URLs are percent-encoded; null page ids come back null and refer last; pages that repeat an
id and payload become a response and revisits of that id; no rows give no rows; further columns are
ignored; pages of any length are written whole.  Archives from elsewhere: bodies are bytes in any encoding;
a URL with spaces is read whole and percent-encoded, as are header bytes that are not UTF-8; HTTP headers
may end in bare line feeds or never end (then the payload is empty).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.arrow import text_slices
from tabflow.llm.scratch import shared_folder, written
from tabflow.sources.parquet import load_table

ARCHIVE_BYTES = 8 << 20

# The header fields of both ARC versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
_UNSAFE = re.compile(r"[\x00-\x20\x7f\s]")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _safe(url: str) -> str:
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _text(line: bytes) -> str:
    """A header line; without UTF-8 its bytes beyond ASCII are percent-encoded."""
    try:
        return line.decode()
    except UnicodeDecodeError:
        return "".join(chr(b) if b < 128 else f"%{b:02X}" for b in line)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _arc_header(version: int, values: dict[str, str]) -> bytes:
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n"


def arc_start(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 tabflow\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return _arc_header(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date,
                                 "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Offset": "0",
                                 "Archive-length": str(len(body))}) + body + b"\n"


def arc_record(version: int, name: str, offset: int, page_id, url: str | None, payload: bytes, date: str) -> bytes:
    """One HTTP response with its ARC header line."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
            f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n").encode()
    safe = _safe(url) if url else "urn:page"
    return _arc_header(version, {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
                                 "Result-code": "200", "Checksum": hashlib.md5(payload).hexdigest(), "Filename": name,
                                 "Offset": str(offset), "Archive-length": str(len(http) + len(payload))}) \
        + http + payload + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, body) of every record after the version block."""
    at, fields = 0, None
    while at < len(data):
        if data[at:at + 1] == b"\n":
            at += 1
            continue
        line_end = data.index(b"\n", at)
        line = _text(data[at:line_end].rstrip(b"\r"))
        parts = line.split(" ")
        length = int(parts[-1])
        body = data[line_end + 1:line_end + 1 + length]
        if len(body) != length:
            raise ValueError(f"ARC record at {at} declares {length} bytes and has {len(body)}")
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with its version block")
            version = int(body.split(b" ", 1)[0])
            fields = _text(body.split(b"\n")[1].rstrip(b"\r")).split(" ")
            if fields != ARC_FIELDS[version]:
                raise ValueError(f"fields of ARC version {version}: {fields}")
        else:
            more = len(parts) - len(fields)
            if more < 0:
                raise ValueError(f"ARC header with {len(parts)} fields: {line[:200]}")
            yield at, dict(zip(fields, [_safe(" ".join(parts[:more + 1])), *parts[more + 1:]])), body    # only URLs hold spaces
        at = line_end + 1 + length


def warc_date(date: str) -> str:
    """WARC date of an ARC date of 14 digits; missing low digits become the earliest time."""
    d = date + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(place: str, offset: int, url: str, date: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}#{offset} {date} {url}')}"


def warc_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record."""
    at = 0
    while at < len(data):
        if data[at:at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        block = data[end + 4:end + 4 + length]
        if len(block) != length:
            raise ValueError(f"WARC record at {at} declares {length} bytes and has {len(block)}")
        yield headers, block
        at = end + 4 + length


def is_http(block: bytes) -> bool:
    return block.startswith(b"HTTP/")


def payload_start(block: bytes) -> int:
    """Where the payload of an HTTP response starts; at the end if its headers never end."""
    end = _HEAD_END.search(block)
    return end.end() if end else len(block)


def http_headers(head: bytes) -> dict[str, str]:
    return dict(line.rstrip("\r").split(": ", 1) for line in head.decode("latin-1").split("\n")[1:] if ": " in line)


def _page_id(http: dict[str, str]) -> int | None:
    value = http.get("X-Page-Id", "").strip()
    number = int(value) if re.fullmatch(r"-?[0-9]{1,19}", value) else None
    return number if number is not None and -2**63 <= number < 2**63 else None


class _Archive:
    """Records joined until an archive is full; one value per archive."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, record: bytes) -> None:
        self.parts.append(record)
        self.size += len(record)

    def take(self) -> pa.RecordBatch:
        data = b"".join(self.parts)
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])   # the writer ends the line


def _write_archives(df: DataFrame, path: str) -> None:
    # a cast keeps every byte, and the text writer writes them as they are
    df.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = "20200101000000") -> None:
    """``pages`` (page_id, url, html) as ARC files; archives of a task alternate between the versions."""

    def run(batches):
        from pyspark import TaskContext
        part, n, archive, version, name = TaskContext.get().partitionId(), 0, _Archive(), 1, ""
        for big in batches:
            for batch in text_slices(big, "html"):
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    if not archive.parts:
                        version, name = (part + n) % 2 + 1, f"pages-{part:05d}-{n:05d}.arc"
                        archive.add(arc_start(version, name, date))
                        n += 1
                    archive.add(arc_record(version, name, archive.size, page_id, url, (html or "").encode(), date))
                    if archive.size >= ARCHIVE_BYTES:
                        yield archive.take()
        if archive.parts:
            yield archive.take()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    _write_archives(rows.mapInArrow(run, "value binary"), path)


def arc_records(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Every record: place, offset, url, ip, date, kind (media type), http, page_id, digest, and with
    ``payloads`` its block."""

    def run(batches):
        for batch in batches:
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                cols = {c: [] for c in ("place", "offset", "url", "ip", "date", "kind", "http", "page_id", "digest", "block")}
                held = 0
                for offset, head, block in read_arc(gzip.decompress(content)):
                    http = is_http(block)
                    start = payload_start(block) if http else 0
                    row = (place, offset, head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], http,
                           _page_id(http_headers(block[:start])) if http else None, sha1_base32(block[start:]),
                           block if payloads else None)
                    for c, v in zip(cols.values(), row):
                        c.append(v)
                    held += len(block) if payloads else 0
                    if held >= ARCHIVE_BYTES or len(cols["url"]) >= 4096:
                        yield _records(cols)
                        cols, held = {c: [] for c in cols}, 0
                if cols["url"]:
                    yield _records(cols)

    return _files(spark, path).mapInArrow(
        run, "place string, offset long, url string, ip string, date string, kind string, http boolean, page_id long, "
             "digest string, block binary")


def _records(cols: dict[str, list]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "page_id": pa.int64(), "block": pa.binary(), "http": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in cols.items()], names=list(cols))


def convert_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Every HTTP record as a WARC response or, where a payload of at least ``min_bytes`` is equal to that
    of a larger page id, as a revisit of it; every other one as a resource."""
    index = written(arc_records(spark, arc_path, False).where("http").drop("block", "kind", "http"), "arc-index")
    last = written(index.groupBy("digest").agg(F.max(F.struct("page_id", "place", "offset", "url", "date")).alias("last")),
                   "arc-last")
    target = index.join(last, "digest").where((F.col("last.place") != F.col("place")) | (F.col("last.offset") != F.col("offset"))) \
        .select("place", "offset", "last")
    target = written(target, "arc-revisits")
    rows = arc_records(spark, arc_path, True).join(target, ["place", "offset"], "left") \
        .select("place", "offset", "url", "ip", "date", "kind", "http", "digest", "block", F.col("last.place").alias("to_place"),
                F.col("last.offset").alias("to_offset"), F.col("last.url").alias("to_url"), F.col("last.date").alias("to_date"))

    def run(batches):
        archive = _Archive()
        for batch in batches:
            for r in _rows(batch):
                if not archive.parts:
                    info = b"software: tabflow\r\nformat: WARC File Format 1.0\r\n"
                    archive.add(warc_record("warcinfo", {
                        "WARC-Record-ID": f"<{record_id(r['place'], -1, 'warcinfo', r['date'])}>",
                        "WARC-Date": warc_date(r["date"]), "Content-Type": "application/warc-fields"}, info))
                block = r["block"]
                headers = {"WARC-Record-ID": f"<{record_id(r['place'], r['offset'], r['url'], r['date'])}>",
                           "WARC-Target-URI": r["url"], "WARC-Date": warc_date(r["date"]), "WARC-IP-Address": r["ip"],
                           "WARC-Payload-Digest": f"sha1:{r['digest']}"}
                kind = "response" if r["http"] else "resource"
                head_end = payload_start(block) if r["http"] else 0
                if r["to_place"] is not None and len(block) - head_end >= min_bytes:
                    kind, block = "revisit", block[:head_end]
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
                    headers["WARC-Refers-To"] = f"<{record_id(r['to_place'], r['to_offset'], r['to_url'], r['to_date'])}>"
                headers["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
                headers["Content-Type"] = "application/http; msgtype=response" if r["http"] else r["kind"]
                archive.add(warc_record(kind, headers, block))
                if archive.size >= ARCHIVE_BYTES:
                    yield archive.take()
        if archive.parts:
            yield archive.take()

    _write_archives(rows.mapInArrow(run, "value binary"), warc_path)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for start in range(0, batch.num_rows, 256):
        for values in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
            yield dict(zip(names, values))


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_id, record_type, refers_to_id, payload_bytes, payload_digest of every record;
    the digests of stored blocks and payloads are recomputed and must agree.  A revisit stores no payload:
    its payload_bytes are null."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                out = {c: [] for c in ("page_id", "record_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest")}
                for head, block in read_warc(gzip.decompress(content)):
                    if head["WARC-Type"] not in ("response", "revisit", "resource"):
                        continue
                    http = head["WARC-Type"] != "resource"
                    start = payload_start(block) if http else 0
                    payload = block[start:]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}" or \
                            (head["WARC-Type"] != "revisit" and digest != sha1_base32(payload)):
                        raise ValueError(f"digest of {head['WARC-Record-ID']} differs")
                    row = (_page_id(http_headers(block[:start])) if http else None, head["WARC-Record-ID"], head["WARC-Type"],
                           head.get("WARC-Refers-To"), None if head["WARC-Type"] == "revisit" else len(payload), digest)
                    for c, v in zip(out.values(), row):
                        c.append(v)
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()],
                                                 names=list(out))

    return _files(spark, path).mapInArrow(
        run, "page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as its WARC record says."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    convert_to_warc(spark, arc, warc, min_bytes)
    return resolved(spark, warc)


def resolved(spark: SparkSession, warc: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, references and the
    sizes of revisited payloads looked up by record identifier."""
    records = written(warc_records(spark, warc), "warc-records")
    targets = records.where("record_type = 'response'") \
        .select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("to_bytes"))
    return records.join(targets, "refers_to_id", "left") \
        .select("page_id", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(load_table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex FROM p),
b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(1, 41), lambda i:
           substr('0000000100100011010001010110011110001001101010111100110111101111',
                  4 * instr('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), '') AS bits FROM x
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER)
                  + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
                  + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS BIGINT),
                  1)), '') AS payload_digest FROM b
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""
