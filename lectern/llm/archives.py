"""Web archives: legacy ARC files (versions 1 and 2), their conversion to WARC, and readers for both.

An ARC file opens with a version block, ``filedesc://`` header line, then a line ``version reserved origin`` and a line
that names the fields of all header lines that follow. Version 1 has five fields, version 2 ten; the last is always the
declared length of what follows in bytes, and only that length says where a record ends. The converter reads these
lines by the field names of their own version block and synthesises the WARC record: an id from file and place, the date
from the 14-digit archive date, the type from scheme, content type and payload groups, digests from the bytes.

=====================================================  ===========================================
ARC record                                             WARC record
=====================================================  ===========================================
version block (``filedesc://``)                        warcinfo, the block kept
block with an HTTP head (not of ``dns:``)              response, or revisit where the payload recurs
content type ``application/warc-fields``, ``text/anvl``  metadata
anything else (``dns:``, no HTTP head)                 resource
=====================================================  ===========================================

All bytes stay bytes: header lines are read as Latin-1, blocks and payloads are never decoded. Files are written with
Spark's own text writer, whose strings are byte strings, so any file system that Spark reaches will do. A row is a whole
file of bounded size (``ARCHIVE_BYTES``, or one record where that is larger); every record is a gzip member of its own.
A reader holds one compressed file and one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded, new_folder, stage
from .textkit import batches_of, texts_of

ARCHIVE_BYTES = 8 << 20
REVISIT_FROM = 1000
#: Header of the pages written here; a server's own headers of other names say nothing about a page.
PAGE_HEADER = "Lectern-Archive-Page"
GZIP_LEVEL = 4
# Field names of the two versions, the profile of a revisit and content types, as the formats define them.
FIELDS_1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
METADATA_TYPES = ("application/warc-fields", "text/anvl")
HTTP_RESPONSE = "application/http; msgtype=response"
_CRLF = b"\r\n"
_DATE = "20240101000000"


def _word(url: str | None, page_id) -> str:
    """A url without white space or control characters, as a header line needs it."""
    text = url or f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def member(data: bytes) -> bytes:
    """A gzip member."""
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def opened(data: bytes) -> io.BufferedIOBase:
    """A stream over the bytes of a file, plain or gzip of any number of members; unpacked as it is read."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def arc_head(version: int, name: str) -> bytes:
    """The version block."""
    body = f"{version} 0 lectern\n{FIELDS_1 if version == 1 else FIELDS_2}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {_DATE} text/plain "
    return (line + ("" if version == 1 else f"200 - - 0 {name} ") + f"{len(body)}\n").encode() + body


def arc_record(version: int, url: str, document: bytes, name: str, offset: int, date: str = _DATE, kind: str = "text/html") -> bytes:
    line = f"{url} 0.0.0.0 {date} {kind} "
    if version == 2:
        line += f"200 {hashlib.md5(document).hexdigest()} - {offset} {name} "
    return (line + f"{len(document)}\n").encode() + document


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, document) of every record, version blocks too; raises ValueError on a broken line or length.

    Header lines are Latin-1; a url with spaces takes what the other fields leave. Zero bytes and line ends between
    records are skipped.
    """
    stream, names = opened(data), None
    while line := stream.readline():
        line = line.lstrip(b"\0").rstrip(b"\r\n")
        if not line:
            continue
        words = line.decode("latin-1").split(" ")
        try:
            size = int(words[-1])
        except ValueError:
            raise ValueError(f"ARC header line without a length: {words[0][:80]}") from None
        block = stream.read(size) if size >= 0 else b""
        if size < 0 or len(block) != size:
            raise ValueError(f"ARC record {words[0][:80]} declares {size} bytes and has {len(block)}")
        if words[0].startswith("filedesc://"):
            lines = block.decode("latin-1").split("\n")
            names = lines[1].strip().split(" ") if len(lines) > 1 else [""]
            if lines[0].split(" ")[0] not in ("1", "2") or names[-1] != "Archive-length":
                raise ValueError("ARC version block is not of version 1 or 2")
        elif names is None or len(words) < len(names):
            raise ValueError(f"ARC header line has {len(words)} fields")
        known = names if len(words) >= len(names) else FIELDS_1.split()
        spare = len(words) - len(known)
        yield dict(zip(known, [" ".join(words[: spare + 1]), *words[spare + 1 :]])), block


def warc_date(arc_date: str) -> str:
    """14 digits (fewer are filled up with the first moment) to the WARC form."""
    digits = "".join(c for c in arc_date if c in "0123456789")[:14]
    digits += "00010101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_hex(digest: str) -> str:
    return base64.b32decode(digest.partition(":")[2]).hex()


def record_id(file: str, number: int) -> str:
    """The id of record ``number`` of a file; records that are equal in all else have ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{number}')}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload); the head ends at the first empty line of either kind."""
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    if not ends:
        return b"", block
    at, size = min(ends)
    return block[: at + size], block[at + size :]


def header_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("latin-1")
    return None


def warc_type(url: str, content_type: str, block: bytes) -> str:
    """Type of the WARC record for an ARC record, before payload groups make revisits of some responses."""
    scheme = url.partition(":")[0].lower()
    if scheme == "filedesc":
        return "warcinfo"
    if scheme != "dns" and block.startswith(b"HTTP/"):
        return "response"
    return "metadata" if content_type.partition(";")[0].strip().lower() in METADATA_TYPES else "resource"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Header lines, an empty line, the block and the two line ends that close a record."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return _CRLF.join(lines) + _CRLF * 2 + block + _CRLF * 2


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record, by declared lengths."""
    stream = opened(data)
    while line := stream.readline():
        line = line.lstrip(b"\0").strip()
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        headers = {}
        while line := stream.readline().strip():
            key, _, value = line.partition(b":")
            headers[key.decode().lower()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"WARC record declares {size} bytes and has {len(block)}")
        yield headers, block


def _files_of(records: Iterable[tuple[int, bytes]]) -> Iterator[tuple[bytes]]:
    """Records with the number of their file, joined to files of one gzip member a record."""
    parts, number = [], None
    for own, record in records:
        if own != number and parts:
            yield (b"".join(parts),)
            parts = []
        number = own
        parts.append(member(record))
    if parts:
        yield (b"".join(parts),)


def _numbered(records: Iterable[bytes], limit: int) -> Iterator[tuple[int, bytes]]:
    """Records with the number of a file of about ``limit`` bytes (before packing)."""
    size = number = 0
    for record in records:
        if size and size + len(record) > limit:
            size, number = 0, number + 1
        size += len(record)
        yield number, record


_FILE = pa.schema([("value", pa.binary())])


def _write_files(files: DataFrame, path: str) -> None:
    """Each value as a file of its own. A cast of bytes to a string changes nothing, and the zero byte that the writer
    puts at the end is padding to a reader of gzip."""
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", "\0").text(path)


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write page_id, url and html as ARC files, versions 1 and 2 in turn; null html is an empty payload."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            number = size = 0
            for batch in batches:
                for page, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                    head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                    document = (head + ("" if page is None else f"{PAGE_HEADER}: {page}\r\n") + "\r\n").encode() + payload
                    if size and size + len(document) > archive_bytes:
                        number, size = number + 1, 0
                    version, name, target = 1 + number % 2, f"part-{number}.arc", _word(url, page)
                    if not size:
                        yield number, arc_head(version, name) + b"\n"
                    target = target if "://" in target else f"http://{target}"
                    yield number, arc_record(version, target, document, name, size) + b"\n"
                    size += len(document)

        yield from batches_of(_files_of(records()), _FILE, 1)

    columns = (F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write_files(pages.select(*columns).mapInArrow(archives, "value binary"), path)


_RECORD = "record_id string, kind string, page long, url string, date string, content_type string, digest string, size long, block binary"


def _schema(text: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, types[k]) for n, k in map(str.split, text.split(", "))])


def arc_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Records of all ARC files under a folder, with the WARC type of each; the page is that of a ``PAGE_HEADER`` line. Without
    ``blocks`` that column is null."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for number, (fields, block) in enumerate(read_arc(data.as_py())):
                        url, content_type = fields["URL"], fields["Content-type"]
                        kind = warc_type(url, content_type, block)
                        head, payload = split_http(block) if kind == "response" else (b"", block)
                        page = header_value(head, PAGE_HEADER)
                        page = int(page) if page and page.lstrip("-").isdigit() else None
                        own = record_id(name.rsplit("/", 1)[-1], number)
                        yield own, kind, page, url, warc_date(fields["Archive-date"]), content_type, sha1_digest(payload), len(payload), block if blocks else None

        yield from batches_of(rows(), _schema(_RECORD), 64 if blocks else 4096)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _RECORD)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Convert every ARC file under a folder. Of responses with equal payloads of at least ``REVISIT_FROM`` bytes the one
    with the largest page id is the response (where none has one, the one with the largest record id), the others are
    revisits of it; rows that repeat the response's page are responses too."""
    records = arc_records(spark, arc_path)
    large = arc_records(spark, arc_path, False).where((F.col("kind") == "response") & (F.col("size") >= REVISIT_FROM))
    first = F.max(F.struct(F.col("page").isNotNull(), "page", "record_id", "url", "date"))
    groups = large.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = bounded(stage(groups.select(F.col("digest").alias("of"), *[F.col(f"first.{x}").alias(f"first_{x}") for x in ("record_id", "page", "url", "date")]), "payload-groups"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written():
            for batch in batches:
                for row in batch.to_pylist():
                    kind, block = row["kind"], row["block"]
                    again = row["first_record_id"] is not None and row["record_id"] != row["first_record_id"] and (row["page"] is None or row["page"] != row["first_page"])
                    if again:
                        kind, block = "revisit", split_http(block)[0]
                    headers = [
                        ("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["url"]),
                        ("WARC-Payload-Digest", row["digest"]), ("WARC-Block-Digest", sha1_digest(block)),
                        ("Content-Type", HTTP_RESPONSE if kind in ("response", "revisit") else row["content_type"]), ("X-Payload-Length", str(row["size"])),
                    ]
                    if kind == "warcinfo":
                        headers[3] = ("WARC-Filename", row["url"].partition("://")[2])
                    if again:
                        headers += [
                            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["first_record_id"]),
                            ("WARC-Refers-To-Target-URI", row["first_url"]), ("WARC-Refers-To-Date", row["first_date"]),
                        ]
                        if row["first_page"] is not None:
                            headers.append(("X-Refers-To-Page", str(row["first_page"])))
                    yield warc_record(headers, block)

        yield from batches_of(_files_of(_numbered(written(), archive_bytes)), _FILE, 1)

    # records that cannot be revisits, such as empty pages, have keys of their own, so none of their payloads is a hot one
    may_revisit = (F.col("kind") == "response") & (F.col("size") >= REVISIT_FROM)
    keyed = records.withColumn("key", F.when(may_revisit, F.col("digest")).otherwise(F.concat(F.lit("-"), "record_id")))
    _write_files(keyed.join(groups, F.col("key") == F.col("of"), "left").mapInArrow(compose, "value binary"), warc_path)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under a folder: type, id, date, url, page_id, payload size and digest, the page and the
    record that a revisit refers to, payload (null for revisits). Block and payload digests are checked."""
    kinds = (
        "record_type string, record_id string, warc_date string, url string, content_type string, page_id long, payload_bytes long, payload_digest string, "
        "refers_to long, refers_to_record string, payload binary"
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for data in batch.column(0):
                    for h, block in read_warc(data.as_py()):
                        if h["warc-block-digest"] != sha1_digest(block):
                            raise ValueError(f"block digest of {h['warc-record-id']} differs")
                        kind, first = h["warc-type"], h.get("x-refers-to-page")
                        head, payload = split_http(block) if kind in ("response", "revisit") else (b"", block)
                        page = header_value(head, PAGE_HEADER)
                        kept = None if kind == "revisit" else payload
                        if kept is not None and h["warc-payload-digest"] != sha1_digest(kept):
                            raise ValueError(f"payload digest of {h['warc-record-id']} differs")
                        yield (kind, h["warc-record-id"], h["warc-date"], h.get("warc-target-uri") or h.get("warc-filename"), h["content-type"],
                               int(page) if page and page.lstrip("-").isdigit() else None, int(h["x-payload-length"]), digest_hex(h["warc-payload-digest"]),
                               first and int(first), h.get("warc-refers-to"), kept)

        yield from batches_of(rows(), _schema(kinds), 64)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, kinds)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url gets a made-up name. A null page_id stays null; its record revisits another
    with an equal payload. Repeated rows make a record each, with ids of their own: all rows of the response's page are
    responses. Other columns are ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    found = read_warcs(spark, warc).where(F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for the registered query.
SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> top THEN top END AS refers_to
FROM g
"""
