"""ARC archives and their conversion to WARC.

An archive file is a run of gzip members, one a record.  Spark's text writer
writes them to any file system it knows: a member ends with the highest byte of
its length, which is zero, so that byte is the writer's line separator.  Files
are bounded by bytes, read as binary files and parsed by their declared lengths.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, new_path, remove

#: Header fields of a URL record, by the version that a version block names.  Fixed values.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Where the URL of a header line ends: an IP address and a date of 14 digits, or its first ones, come next.
_PLACE = re.compile(r"^(.*) ([0-9A-Fa-f.:]+|-) ([0-9]{4}(?:[0-9]{2}){0,5}) (.*)$", re.S)
#: Compressed bytes of a file, but for its last record; bytes of a record that go into one gzip member.
FILE_BYTES, MEMBER_BYTES = 1 << 25, 1 << 23
#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 100
DATE = "20000101000000"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    content: bytes


def _header(version: int, url: str, date: str, kind: str, size: int, name: str) -> bytes:
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{more} {size}\n".encode()


def version_block(version: int, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 skein\n{FIELDS[version]}\n".encode()
    return _header(version, f"filedesc://{name}", date, "text/plain", len(body), name) + body


def arc_record(version: int, url: str, date: str, kind: str, content: bytes, name: str) -> bytes:
    return _header(version, url, date, kind, len(content), name) + content


def parse_header(line: str, version: int | None) -> tuple[int, ArcRecord, int]:
    """The version, a record without content, and the declared length.

    The IP address and the date part the URL, spaces included, from the rest.
    Version 1: the type, spaces included, and the length.  Version 2: five more
    fields between these.  ``version`` None: told by the fields.
    """
    m = _PLACE.match(line)
    if not m:
        raise ValueError(f"no ARC header: {line[:80]!r}")
    url, ip, date, rest = m.groups()
    datetime.datetime.strptime(full_date(date), "%Y%m%d%H%M%S")
    long = rest.rsplit(" ", 6)
    if version is None:
        version = 2 if len(long) == 7 and re.fullmatch("[0-9]{3}|-", long[1]) and long[4].isdigit() else 1
    kind, *_, size = long if version == 2 else rest.rsplit(" ", 1)
    if (version == 2 and len(long) != 7) or not size.isdigit():
        raise ValueError(f"no ARC header: {line[:80]!r}")
    return version, ArcRecord(url, ip, date, kind, b""), int(size)


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an ARC stream after its version blocks.

    A version block sets the header fields of what follows; before any, a
    header's own fields tell.  A header line that doesn't parse, or a record
    shorter than it declares, is a ValueError.
    """
    version = None
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        block = line.startswith(b"filedesc://")
        _, rec, size = parse_header(line.decode("utf-8", "replace"), None if block else version)
        rec.content = stream.read(size)
        if len(rec.content) != size:
            raise ValueError(f"ARC record cut short: {line[:80]!r}")
        if block:
            version = 2 if rec.content.split(b" ", 1)[0] == b"2" else 1
        else:
            yield rec


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The header block, its blank line included, and the body; a content without an HTTP header is all body."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, blank, body = content.partition(b"\r\n\r\n")
    return (head + blank, body) if blank else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode()
    return None


def full_date(arc_date: str) -> str:
    """14 digits; what the date leaves out is the earliest."""
    return (arc_date + "00000101000000"[len(arc_date) :])[:14]


def warc_date(arc_date: str) -> str:
    d = full_date(arc_date)
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str) -> str:
    """A WARC-Record-ID that depends on the record alone: converting again gives it again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest}')}>"


def warc_record(rec: ArcRecord, digest: str, first: tuple[str, str, str] | None, extra: dict[str, str]) -> bytes:
    """A WARC/1.1 record without its closing blank lines.  ``first``: record id,
    URL and date of the response that this one revisits."""
    head, body = split_http(rec.content)
    block = head if first else rec.content
    kind = "revisit" if first else "response" if head else "resource"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(rec.url, rec.date, digest + extra.get("WARC-X-Page-Id", "")),
        "WARC-Date": warc_date(rec.date),
        "WARC-Target-URI": rec.url,
        "WARC-IP-Address": rec.ip,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if first:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": first[0], "WARC-Refers-To-Target-URI": first[1], "WARC-Refers-To-Date": first[2]}
    fields |= extra | {"Content-Type": "application/http;msgtype=response" if head else rec.type, "Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-cased name, block) of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            fields[key.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("WARC record cut short")
        yield fields, block


def member(data: bytes, most: int = MEMBER_BYTES) -> bytes:
    """Gzip members that hold ``data``, at most ``most`` (below 2^24) bytes each: they end with a zero byte."""
    return b"".join(gzip.compress(data[i : i + most], 3, mtime=0) for i in range(0, max(1, len(data)), most))


#: What a record's row needs to be written: its file and its place in the partition.
RECORD = "file int, at long, value binary"


def _rows(records: Iterator[bytes], first: Callable[[int], bytes], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``RECORD``: members are dealt out to files of bounded size, each
    of which begins with ``first()``."""
    file, at, held, rows, size = -1, 0, file_bytes, [], 0
    for record in records:
        if held >= file_bytes:
            file, held = file + 1, 0
            record = [first(file), record]
        else:
            record = [record]
        for value in map(member, record):
            rows.append((file, at, value[:-1]))
            at, held, size = at + 1, held + len(value), size + len(value)
        if size > 1 << 22 or len(rows) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["file", "at", "value"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["file", "at", "value"])


def _write(df: DataFrame, path: str) -> None:
    """Writes rows of ``RECORD``: each partition's files have its rows in order."""
    df = df.sortWithinPartitions("file", "at").select("file", F.col("value").cast("string").alias("value"))
    df.write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(path)


def _files(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.format("binaryFile").load(path).select("content")


def _open(content: bytes) -> io.BufferedIOBase:
    if content[:2] != b"\x1f\x8b":
        return io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, file_bytes: int = FILE_BYTES) -> None:
    """Writes an ARC record for each row, as an HTTP response whose ``X-Page-Id``
    field holds the id.  Partitions alternate between versions 1 and 2.  White
    space and control characters in a URL become ``%20``; a null URL is
    ``about:blank``; a null payload is empty."""
    src = pages.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7f\u0085  ]", "%20"), F.lit("about:blank")).alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 2 - part % 2
        name = lambda file: f"skein-{part:06d}-{file:04d}.arc.gz"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for k in range(batch.num_rows):
                    i, url, html = (c[k].as_py() for c in batch.columns)
                    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if i is None else f"X-Page-Id: {i}\r\n") + f"Content-Length: {len(html)}\r\n\r\n"
                    yield arc_record(version, url or "about:blank", DATE, "text/html", head.encode() + html, "skein") + b"\n"

        yield from _rows(records(), lambda file: version_block(version, name(file)) + b"\n", file_bytes)

    _write(src.mapInArrow(run, RECORD), path)


def _warcinfo(name: str) -> bytes:
    body = b"software: skein\r\nformat: WARC File Format 1.1\r\n"
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, DATE, ""), "WARC-Date": warc_date(DATE), "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def arc_records(arcs: DataFrame) -> DataFrame:
    """The records of ARC files (binary column ``content``, gzip or plain) as a
    table: id (``X-Page-Id``), payload digest and size, header fields, the
    content compressed and its length.  Each archive is opened, and each payload
    hashed, once; nothing later reads the archives."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64())
        codec = pa.Codec("zstd", 3)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "digest", "size", "url", "ip", "date", "type", "content", "n"])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in read_arc(_open(content.as_py())):
                    head, body = split_http(r.content)
                    i = http_field(head, "X-Page-Id")
                    rows.append((None if i is None else int(i), hashlib.sha256(body).hexdigest(), len(body), r.url, r.ip, r.date, r.type, codec.compress(r.content, asbytes=True), len(r.content)))
                    size += len(rows[-1][7])
                    if size > 1 << 22:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return materialize(arcs.mapInArrow(parse, "id long, digest string, size long, url string, ip string, date string, type string, content binary, n long"), "arc-records")


def records_to_warc(records: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Writes ``arc_records`` as WARC files at ``path``.

    Records get an identifier that depends on their content, a WARC date,
    payload and block digests, and a type: of records with equal payloads of at
    least ``LEAST_SHARED`` bytes the one with the smallest id is a response and
    the others are revisits.  Equal payloads of one id, and those without any
    id, stay responses; a record without id revisits one with an id.  The
    records go through the shuffle compressed.
    """
    known = records.where(F.col("size") >= LEAST_SHARED)
    first = known.groupBy("digest").agg(F.min("id").alias("lead_id"), F.count("*").alias("n")).where("n > 1 AND lead_id IS NOT NULL").select("digest", "lead_id")
    first = materialize(first, "arc-first")
    lead = known.select("digest", "id", "url", "date").join(first, "digest").where("id = lead_id").groupBy("digest", "lead_id").agg(F.min(F.struct("url", "date")).alias("r"))
    lead = materialize(lead.select(F.col("digest").alias("same"), "lead_id", F.col("r.url").alias("first_url"), F.col("r.date").alias("first_date")), "arc-lead")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codec = TaskContext.get().partitionId(), pa.Codec("zstd")

        def rows() -> Iterator[bytes]:
            for batch in batches:
                for k in range(batch.num_rows):
                    i, digest, url, ip, date, kind, content, n, first, first_url, first_date = (c[k].as_py() for c in batch.columns)
                    extra = {} if i is None else {"WARC-X-Page-Id": str(i)}
                    to = None
                    if first is not None:
                        to = record_id(first_url, first_date, digest + str(first)), first_url, warc_date(first_date)
                        extra["WARC-X-Refers-To-Page-Id"] = str(first)
                    yield warc_record(ArcRecord(url, ip, date, kind, codec.decompress(content, n, asbytes=True)), digest, to, extra) + b"\r\n\r\n"

        yield from _rows(rows(), lambda file: _warcinfo(f"skein-{part:06d}-{file:04d}.warc.gz"), file_bytes)

    joined = records.join(lead.hint("merge"), (F.col("digest") == F.col("same")) & (F.col("size") >= LEAST_SHARED) & F.coalesce(F.col("id") != F.col("lead_id"), F.lit(True)), "left")
    _write(joined.select("id", "digest", "url", "ip", "date", "type", "content", "n", "lead_id", "first_url", "first_date").mapInArrow(convert, RECORD), path)
    discard(first, lead)


def arc_to_warc(arcs: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Converts ARC files (binary column ``content``) to WARC files at ``path``."""
    records = arc_records(arcs)
    records_to_warc(records, path, file_bytes=file_bytes)
    discard(records)


def read_warcs(files: DataFrame) -> DataFrame:
    """A row per record of WARC files (binary column ``content``): page_id,
    url, record_id, date, payload_bytes, payload_digest, record_type, refers_to.
    A response's payload must have the digest it declares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_id", "date", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in read_warc(_open(content.as_py())):
                    if f["warc-type"] == "warcinfo":
                        continue
                    digest = f["warc-payload-digest"].partition(":")[2]
                    head, body = split_http(block)
                    if f["warc-type"] == "revisit":
                        size = int(http_field(head, "Content-Length") or 0)
                    else:
                        size = len(body)
                        if hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"payload of {f['warc-record-id']} doesn't match its digest")
                    i, to = f.get("warc-x-page-id"), f.get("warc-x-refers-to-page-id")
                    rows.append((None if i is None else int(i), f["warc-target-uri"], f["warc-record-id"], f["warc-date"], size, digest, f["warc-type"], None if to is None else int(to)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, "page_id long, url string, record_id string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as ARC files, converts them to WARC
    and reads these back.  The WARC files stay in the shared folder; the ARC
    files go once their records are a table.

    One row per page, repeated rows included.  A null url is ``about:blank``, a
    null html an empty payload; pages without id can't be referred to.  Of equal
    payloads the smallest id is the response, and so are its repeated rows.  A
    page of any size is one record.  An empty table gives no rows; other columns
    are ignored."""
    arc, warc = new_path(pages.sparkSession, "arc"), new_path(pages.sparkSession, "warc")
    write_arc(pages, arc)
    records = arc_records(_files(pages, arc))
    remove(pages.sparkSession, arc)
    records_to_warc(records, warc)
    discard(records)
    return read_warcs(_files(pages, warc))
