"""ARC archives to WARC: parsing, conversion, deduplicated writing and reading back.

An ARC file opens with a version block whose second line names the fields of
every header line that follows: five in version 1, ten in version 2.  A record
is its header line and as many bytes as that line declares.  The converter
synthesises what WARC asks for besides: record identifiers (from target, date
and payload), W3C timestamps, record types and SHA-1 digests in base32.

Archives are rows (name, content) of bounded size, so that Spark deals them out.
They are parsed once, into a table in the shared folder.  WARC files are closed
beyond ``WARC_BYTES``; each record is a gzip member, and each file one row of
Spark's text sink, which writes a file a row.  They are read back through
``binaryFile``.  Only page numbers and digests are shuffled to find equal payloads,
then each record once.

Header lines are read from both ends: the length is their last field, and where a
target or a content type holds spaces the date (of 14 digits, as a rule) behind an
address tells the fields apart.  A line without a date and a readable length is no
header: it and what follows it up to the next header line are one record with empty
fields, marked ``unspecified``.

Defined results: a null payload is empty; a null url becomes ``urn:page:<id>``;
a row with a null page_id is always a response; rows of one page_id with equal
payloads are all responses if that page_id is the smallest; an empty table gives
no archives and no rows; a record whose declared length exceeds its file is kept
and marked ``length``; both marks become ``WARC-Truncated``.  Columns other than the
three named play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, scratch, ship

#: Fixed values of the ARC format: the field names of its two versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ARC_BYTES = 2 << 20  # an archive is closed beyond this
WARC_BYTES = 16 << 20  # and a WARC file
NO_DATE = "19700101000000"
RECORDS = "uri string, ip string, date string, content_type string, page_id bigint, http binary, payload binary, payload_digest string, truncated string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def w3c_date(arc_date: str) -> str:
    d = (re.sub(r"\D", "", arc_date or "") + NO_DATE[len(re.sub(r"\D", "", arc_date or "")) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(uri: str, date: str, digest: str, page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {digest} {page_id}')}>"


# --- ARC ---------------------------------------------------------------------


def arc_version_block(name: str, version: int, date: str = NO_DATE) -> bytes:
    body = f"{version} 0 lodestone\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(uri: str, date: str, content_type: str, block: bytes, version: int, name: str, offset: int) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    fields = {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": content_type, "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


_DATE = re.compile(r"\d{8}|\d{10}|\d{12}|\d{14}|\d{17}")
_ADDRESS = re.compile(r"\d{1,3}(\.\d{1,3}){3}|[0-9a-fA-F:.]*:[0-9a-fA-F:.]*|-")


def arc_header(line: str, names: list[str]) -> dict[str, str] | None:
    """Fields of a header line, or null if it is none: its last field is the length, a date stands behind an address."""
    values = line.split(" ")
    extra = len(values) - len(names)
    at = names.index("Archive-date")
    if extra < 0 or not values[-1].isdigit():
        return None
    after = len(names) - at - 1  # fields behind the date
    dated = [i for i in range(at, len(values) - after) if _DATE.fullmatch(values[i])]
    behind = [i for i in dated if _ADDRESS.fullmatch(values[i - 1])] or ([at] if extra == 0 and values[at].isdigit() else dated)
    if not behind:
        return None
    i = behind[0]
    tail = len(values) - (after - 1)  # where the content type ends
    values = [" ".join(values[: i - at + 1]), *values[i - at + 1 : i + 1], " ".join(values[i + 1 : tail]), *values[tail:]]
    return dict(zip(names, values, strict=True))


def parse_arc(content: bytes):
    """(fields, block, mark) of every record after the version block; field names come from that block, the mark is null, ``length`` or ``unspecified``."""
    pos, names, first = 0, None, True

    def line_at(p: int):
        end = content.find(b"\n", p)
        end = len(content) if end < 0 else end
        return end, content[p:end].decode("utf-8", "replace").rstrip("\r")

    while pos < len(content):
        if content[pos : pos + 1] in (b"\n", b"\r"):
            pos += 1
            continue
        end, line = line_at(pos)
        fields = arc_header(line, names or ARC_FIELDS[2 if line.count(" ") >= 9 else 1])
        if fields is None:
            begin = pos
            while pos < len(content):  # on to the next header line
                end, line = line_at(pos)
                if pos > begin and ":" in line and arc_header(line, names or ARC_FIELDS[1]):
                    break
                pos = end + 1
            yield dict.fromkeys(names or ARC_FIELDS[1], ""), content[begin:pos], "unspecified"
            continue
        length = int(fields["Archive-length"])
        block = content[end + 1 : end + 1 + length]
        pos = end + 1 + length
        opening, first = first, False
        if opening and fields["URL"].startswith("filedesc://"):  # later ones are pages
            lines = block.decode("utf-8", "replace").split("\n")
            if len(lines) > 1 and {"Archive-date", "Content-type", "Archive-length"} <= set(lines[1].split()):
                names = lines[1].split()
            continue
        yield fields, block, "length" if len(block) < length else None


def pages_to_arc(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", version: int | None = None) -> DataFrame:
    """(name, content): ARC archives of HTTP responses; versions 1 and 2 in turn unless one is given."""
    ship(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        pid, k, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def name():
            return f"pages-{pid:06d}-{k:06d}.arc"

        def out():
            return pa.RecordBatch.from_arrays([pa.array([name()]), pa.array([b"".join(parts)], pa.binary())], ["name", "content"])

        for batch in batches:
            for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = version or 1 + k % 2
                if not parts:
                    parts = [arc_version_block(name(), v)]
                    size = len(parts[0])
                payload = (h or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + (f"X-Page-Id: {i}\r\n" if i is not None else "") + "\r\n"
                parts.append(arc_record(u if u else f"urn:page:{i}", NO_DATE, "text/html", head.encode() + payload, v, name(), size))
                size += len(parts[-1])
                if size >= ARC_BYTES:
                    yield out()
                    parts, k = [], k + 1
        if parts:
            yield out()

    return pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(run, "name string, content binary")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header bytes (with the blank line) and payload; a block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


def header_value(http: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", http)
    return m[1].decode("utf-8", "replace").strip() if m else None


def _long(number: str | None) -> int | None:
    """A page's number, if it is one and fits into 64 bits."""
    n = int(number) if number and re.fullmatch(r"-?\d{1,19}", number) else None
    return n if n is not None and -(2**63) <= n < 2**63 else None


def arc_records(arcs: DataFrame) -> DataFrame:
    """Parsed records of archives (``content`` binary): ``RECORDS``."""
    ship(arcs.sparkSession)
    names = [c.split(" ")[0] for c in RECORDS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block, cut in parse_arc(content.as_py() or b""):
                    http, payload = split_http(block)
                    number = header_value(http, b"X-Page-Id")
                    rows.append((f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], _long(number), http, payload, digest32(payload), cut))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return arcs.select("content").mapInArrow(run, RECORDS)


# --- WARC --------------------------------------------------------------------


def repeated(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, refers_to) of every record that revisits one of a smaller page_id."""
    seen = records.where(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes)).groupBy("page_id", "payload_digest").agg(F.first("size").alias("size"))
    first = seen.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    first = materialise(first, "responses")
    return seen.join(first, "payload_digest").where(F.col("page_id") != F.col("refers_to")).select("page_id", "payload_digest", "refers_to")


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    return (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(data) + z.flush()


def write_warc(records: DataFrame, revisits: DataFrame, path: str, close_at: int = WARC_BYTES) -> None:
    """WARC files (a gzip member a record) of ``RECORDS``; those in ``revisits`` keep their HTTP headers and refer to the response."""
    ship(records.sparkSession)
    joined = records.join(revisits, ["page_id", "payload_digest"], "left").select("uri", "ip", "date", "content_type", "page_id", "http", "payload", "payload_digest", "truncated", "refers_to")

    def run(batches):
        held, size = [], 0

        def closed():
            # a member ends in its length, the last byte of which is 0 below 16 MB; that byte is written by the sink
            data = b"".join(held)
            data = data if data[-1] == 0 else data + gzip_member(b"")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for uri, ip, date, kind, page, http, payload, digest, cut, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held:
                    held.append(gzip_member(warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"), ("WARC-Date", w3c_date(NO_DATE)), ("Content-Type", "application/warc-fields")], b"software: lodestone\r\nformat: WARC File Format 1.1\r\n")))
                when = w3c_date(date)
                headers = [("WARC-Record-ID", record_id(uri, when, digest, page)), ("WARC-Date", when), ("WARC-Target-URI", uri or "urn:unknown"), ("WARC-IP-Address", ip or "0.0.0.0"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if page is not None:
                    headers.append(("X-Page-Id", str(page)))
                if cut:
                    headers.append(("WARC-Truncated", cut))
                if http:
                    headers.append(("Content-Type", "application/http; msgtype=response"))
                else:
                    headers.append(("Content-Type", kind or "application/octet-stream"))
                if first is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(first))]
                    record = warc_record("revisit", [*headers, ("X-Payload-Length", str(len(payload)))], http)
                else:
                    record = warc_record("response" if http else "resource", [*headers, ("WARC-Block-Digest", f"sha1:{digest32(http + payload)}")], http + payload)
                held.append(gzip_member(record))
                size += len(held[-1])
                if size >= close_at:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    files = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(content: bytes):
    """The gzip members of a file, one at a time; a file that is not compressed is one."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, pos = memoryview(content), 0
    while content[pos : pos + 2] == b"\x1f\x8b":
        z, out = zlib.decompressobj(31), []
        while not z.eof and pos < len(view):
            part = view[pos : pos + 16384]
            out.append(z.decompress(part))
            pos += len(part)
        pos -= len(z.unused_data)
        yield b"".join(out)


def parse_warc(content: bytes):
    """(headers, block) of every record of one file."""
    for data in members(content):
        pos = 0
        while (pos := data.find(b"WARC/", pos)) >= 0:
            end = data.find(b"\r\n\r\n", pos)
            if end < 0:
                break
            headers = {}
            for line in data[pos:end].decode("utf-8", "replace").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                headers[k.strip().lower()] = v.strip()
            n = int(headers.get("content-length", "0"))
            yield headers, data[end + 4 : end + 4 + n]
            pos = end + 4 + n


READ = "record_id string, record_type string, uri string, date string, page_id bigint, payload_bytes bigint, payload_digest string, digest_ok boolean, refers_to bigint, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Responses, resources and revisits of the WARC files in ``path``: ``READ``."""
    ship(spark)
    names = [c.split(" ")[0] for c in READ.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary()]
    number = lambda v: int(v) if v else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse_warc(content.as_py()):
                    if h["warc-type"] not in ("response", "resource", "revisit"):
                        continue
                    _, payload = split_http(block)
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    again = h["warc-type"] == "revisit"
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-date"), number(h.get("x-page-id")), int(h["x-payload-length"]) if again else len(payload), said, again or digest32(payload) == said, number(h.get("x-refers-to-page-id")), payload if with_payload and not again else None))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def convert(arcs: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives to WARC files in ``path``; of equal payloads of ``least_bytes`` or more all but one become revisits."""
    records = materialise(arc_records(arcs), "arc-records")
    slim = records.select("page_id", "payload_digest", F.length("payload").alias("size"))
    write_warc(records, materialise(repeated(slim, least_bytes), "revisits"), path)


def pages_through_warc(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages as ARC, converted to WARC, written to the shared folder and read back."""
    path = scratch(pages.sparkSession, "warc")
    convert(pages_to_arc(pages), path, least_bytes)
    return read_warc(pages.sparkSession, path, with_payload=False)
