"""Conversion of legacy ARC archives to WARC.

ARC files (versions 1 and 2) are parsed by their version's URL-record definition and by declared lengths.
From each record the converter synthesises what WARC asks for: a record id, an ISO date, a type, and
block and payload digests. Records with equal payloads become revisits of one response.

WARC files are written by Spark's own text sink, so that any store that Spark can write will do and a
lost task leaves nothing behind. One row is one file: gzip members, one for each record, up to a bounded number of
bytes. The sink ends each row with a separator, which here is the zero byte that ends the last member (the
high byte of a member's length below 16 MB; after longer ones an empty member follows). The driver then gives files
their ``.warc.gz`` names. They are read as binary files, unpacked as a stream.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.shipping import ship
from larkspan.tables import Workspace, lookup

#: Fields of an ARC record line, by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
_EMPTY_MEMBER = gzip.compress(b"", 6, mtime=0)
#: Payloads below this size are kept even if another record has the same.
LEAST_REVISIT = 100
#: Bytes of records in an ARC made of pages; a longer page has an archive of its own.
ARC_BYTES = 2 << 20
#: Bytes of a WARC file; a longer record has a file of its own.
FILE_BYTES = 64 << 20
#: Of gzip: higher levels take twice the time for a twentieth of the size.
LEVEL = 1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_EPOCH = datetime.datetime(2000, 1, 1, tzinfo=datetime.UTC)


@dataclass
class ArcRecord:
    """A record of an ARC file: its line's fields and its body."""

    archive: str
    offset: int
    fields: dict[str, str]
    body: bytes

    @property
    def date(self) -> str:
        """ISO 8601 from 4 to 14 digits; the epoch's year if there are none."""
        digits = "".join(c for c in self.fields.get("date", "") if c.isdigit())[:14]
        full = digits + "00000101000000"[len(digits) :] if len(digits) >= 4 else "19700101000000"
        try:
            return datetime.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            return "1970-01-01T00:00:00Z"

    @property
    def identifier(self) -> str:
        """The same for the same place, address, date and body in each run. Archives of one name can therefore share an id only for one and the same record."""
        body = hashlib.sha1(self.body).hexdigest()
        return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join([self.archive, str(self.offset), self.fields.get('url', ''), self.fields.get('date', ''), body]))}>"

    def http(self) -> tuple[bytes, bytes] | None:
        """Head and payload of an HTTP response, else None."""
        if not self.body.startswith(b"HTTP/"):
            return None
        head, end, payload = self.body.partition(b"\r\n\r\n")
        if not end:
            head, end, payload = self.body.partition(b"\n\n")
        return head + end, payload


class ArcError(ValueError):
    """A file that doesn't follow the format."""


def read_arc(archive: str, data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, plain or in gzip members, without its first, which describes the file."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"{archive}: a record line without an end at {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not version:
            # The first line's own number of fields tells nothing: its body names the version.
            size = _length(archive, at, values)
            if not values[0].startswith("filedesc://"):
                raise ArcError(f"{archive}: it doesn't begin with a file description")
            described = data[end + 1 : end + 1 + size]
            version = int(described[:1]) if described[:1] in (b"1", b"2") else 0
            if not version:
                raise ArcError(f"{archive}: unknown version {described[:20]!r}")
        else:
            names = ARC_FIELDS[version]
            if len(values) < len(names):
                raise ArcError(f"{archive}: a record line of {len(values)} fields at {at}")
            # An address may hold spaces; the fields after it can't.
            parts = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
            size = _length(archive, at, values)
            if end + 1 + size > len(data):
                raise ArcError(f"{archive}: a record of {size} bytes at {at} goes beyond the end")
            yield ArcRecord(archive, at, dict(zip(names, parts, strict=True)), data[end + 1 : end + 1 + size])
        at = end + 1 + size


def _length(archive: str, at: int, values: list[str]) -> int:
    if not values[-1].isdigit():
        raise ArcError(f"{archive}: no length at {at}")
    return int(values[-1])


def write_arc(archive: str, version: int, records: Iterable[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, 14-digit date, type, body)."""
    described = f"{version} 0 larkspan\n".encode() + ARC_TITLES[version] + b"\n"
    first = f"filedesc://{archive} 0.0.0.0 20000101000000 text/plain " + ("" if version == 1 else f"200 - - 0 {archive} ") + f"{len(described)}\n"
    out = bytearray(first.encode() + described + b"\n")
    for url, ip, date, kind, body in records:
        more = "" if version == 1 else f"200 - - {len(out)} {archive} "
        out += f"{url} {ip} {date} {kind} {more}{len(body)}\n".encode() + body + b"\n"
    return bytes(out)


def _headers(lines: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


def payload_digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def to_warc(record: ArcRecord, first: tuple[str, str, str] | None = None, identifier: str | None = None, digest: str | None = None) -> bytes:
    """The record as a WARC record without the blank line after it; ``first`` (id, address and date of the response with the same payload) makes it a revisit. Its id and payload digest are worked out unless they are given."""
    parts = record.http()
    payload = parts[1] if parts else record.body
    kind = "revisit" if first else "response" if parts or record.fields["url"].startswith("dns:") else "resource"
    block = parts[0] if first and parts else b"" if first else record.body
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", identifier or record.identifier),
        ("WARC-Date", record.date),
        ("WARC-Target-URI", record.fields["url"]),
        ("WARC-IP-Address", record.fields.get("ip", "0.0.0.0")),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("WARC-Payload-Digest", "sha256:" + (digest or payload_digest(payload))),
    ]
    if first:
        lines += [("WARC-Refers-To", first[0]), ("WARC-Refers-To-Target-URI", first[1]), ("WARC-Refers-To-Date", first[2]), ("WARC-Profile", PROFILE)]
    lines += [("Content-Type", "application/http; msgtype=response" if parts else record.fields.get("type", "application/octet-stream")), ("Content-Length", str(len(block)))]
    return _headers(lines) + block


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes
    http_headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    def __post_init__(self) -> None:
        self.payload = self.block
        if self.headers.get("content-type", "").startswith("application/http"):
            head, _, self.payload = self.block.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")[1:]
            self.http_headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class WarcError(ValueError):
    """A file that doesn't follow the format, or whose digest doesn't hold."""


def _unpacked(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Pieces of a file that may be plain or of one or more gzip members. What is unpacked isn't copied again."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise WarcError("the file ends within a gzip member")
            out = member.decompress(piece)
            at += len(piece) - len(member.unused_data)
            yield out


def read_warc(name: str, data: bytes) -> Iterator[WarcRecord]:
    """Records of a WARC file; holds one record at a time besides the file. Block and payload digests are checked."""
    pieces, held = _unpacked(data), bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            try:
                held.extend(next(pieces))
            except StopIteration:
                return False
        return True

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        if not fill(1):
            return
        if held[:2] == b"\r\n" or (fill(2) and held[:2] == b"\r\n"):
            continue
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(held) + 1):
                raise WarcError(f"{name}: a record without an end of headers")
            end = held.find(b"\r\n\r\n")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"{name}: {lines[0][:20]!r} in place of a record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not fill(end + 4 + size):
            raise WarcError(f"{name}: a record goes beyond the end")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        record = WarcRecord(headers, block)
        told = headers.get("warc-block-digest", "")
        if told.startswith("sha1:") and told[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise WarcError(f"{name}: a block differs from its digest")
        told = headers.get("warc-payload-digest", "")
        if headers.get("warc-type") != "revisit" and told.startswith("sha256:") and told[7:] != payload_digest(record.payload):
            raise WarcError(f"{name}: a payload differs from its digest")
        yield record


def _page_record(page_id: int | None, url: str | None, html: str | None) -> tuple[str, str, str, str, bytes]:
    payload = (html or "").encode()
    address = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{'' if page_id is None else page_id}"
    known = b"" if page_id is None else f"X-Page-Id: {page_id}\r\n".encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + known + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    # A date for each page that depends on its id alone.
    date = (_EPOCH + datetime.timedelta(seconds=(page_id or 0) % (20 * 365 * 86400))).strftime("%Y%m%d%H%M%S")
    return address, "0.0.0.0", date, "text/html", head + payload


def pages_as_arc(pages: DataFrame, arc_bytes: int = ARC_BYTES) -> DataFrame:
    """``archive, content``: ARC files of ``pages(page_id, url, html)``, versions 1 and 2 in turn, for conversion.

    Null html is an empty payload, a null address ``urn:page:`` with the id; the id is kept as a header. Archives are
    named by partition and place in it: the result is meant to be written before it is read more than once.
    """
    ship(pages.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, count = [], 0, 0
        partition = TaskContext.get().partitionId()

        def flush() -> pd.DataFrame:
            nonlocal held, size, count
            # No two archives of a table have one name.
            name = f"pages-{partition:06d}-{count:06d}.arc"
            out = pd.DataFrame({"archive": [name], "content": [write_arc(name, 1 + count % 2, held)]})
            held, size, count = [], 0, count + 1
            return out

        for part in parts:
            for i, url, html in zip(part["page_id"].astype("Int64").tolist(), part["url"], part["html"], strict=True):
                record = _page_record(None if i is pd.NA else i, url, html)
                if held and size + len(record[4]) > arc_bytes:
                    yield flush()
                held.append(record)
                size += len(record[4])
        if held:
            yield flush()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "archive string, content binary")


def _page_id(head: bytes) -> int | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"x-page-id":
            return int(value)
    return None


_FIELDS = "archive string, offset long, fields map<string,string>, page_id long, digest string, bytes long, record_id string, url string, date string"


def parsed(archives: DataFrame, bodies: bool) -> DataFrame:
    """The records of ``archives(archive, content)``, with or without their bodies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["archive"], part["content"], strict=True):
                rows = []
                for r in read_arc(name, content):
                    http = r.http()
                    payload = http[1] if http else r.body
                    rows.append((name, r.offset, r.fields, _page_id(http[0]) if http else None, payload_digest(payload), len(payload), r.identifier, r.fields["url"], r.date, r.body))
                out = pd.DataFrame(rows, columns=["archive", "offset", "fields", "page_id", "digest", "bytes", "record_id", "url", "date", "body"]).astype({"page_id": "Int64"})
                yield out if bodies else out.drop(columns="body")

    return archives.mapInPandas(run, _FIELDS + (", body binary" if bodies else ""))


def _named(spark: SparkSession, folder: str) -> None:
    """Give the sink's files the ending of WARC files. Only names are touched; files come by size, not by record."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(top):
        old = status.getPath()
        if old.getName().startswith("part-") and old.getName().endswith(".txt") and not fs.rename(old, path(top, old.getName()[:-4] + ".warc.gz")):
            raise OSError(f"{old} can't be renamed")


def convert(archives: DataFrame, folder: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Write the records of ``archives(archive, content)`` to WARC files of about ``file_bytes`` in ``folder``, one gzip member a record.

    Of records with equal payloads of ``least`` bytes or more, the one with the smallest page id (then
    address, date and record id; null id last) is the response; the others revisit it, but for
    records with that same page id, which are responses too. Bodies aren't shuffled unless
    there are more revisits than a broadcast may hold.
    """
    ws = Workspace(archives.sparkSession, "warc")
    index = ws.table(parsed(archives, bodies=False).drop("fields", "archive", "offset"), "index")
    place = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url", "date", "record_id")
    firsts = index.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("__digest"), "first")
    revisits = index.join(firsts, (F.col("digest") == F.col("__digest")) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    revisits = ws.table(revisits.select(F.col("record_id").alias("__id"), "first").dropDuplicates(["__id"]), "revisits")
    records = parsed(archives, bodies=True).join(lookup(revisits), F.col("record_id") == F.col("__id"), "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = bytearray()

        def flush() -> pd.DataFrame:
            # The sink's separator is the last byte.
            held.extend(b"" if held[-1] == 0 else _EMPTY_MEMBER)
            out = pd.DataFrame({"file": [bytes(held[:-1])]})
            held.clear()
            return out

        for part in parts:
            for name, offset, fields, body, own_id, digest, first_id, first_url, first_date in zip(*(part[c] for c in ("archive", "offset", "fields", "body", "record_id", "digest", "first_id", "first_url", "first_date")), strict=True):
                record = to_warc(ArcRecord(name, offset, dict(fields), body), (first_id, first_url, first_date) if first_id else None, own_id, digest)
                member = gzip.compress(record + RECORD_END, LEVEL, mtime=0)
                if held and len(held) + len(member) > file_bytes:
                    yield flush()
                held.extend(member)
        if held:
            yield flush()

    chosen = records.select("archive", "offset", "fields", "body", "record_id", "digest", *[F.col(f"first.{a}").alias(b) for a, b in (("record_id", "first_id"), ("url", "first_url"), ("date", "first_date"))])
    written = chosen.mapInPandas(run, "file binary").select(F.col("file").cast("string").alias("value"))
    written.write.mode("overwrite").option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)
    _named(archives.sparkSession, folder)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, record_type, url, date, page_id, payload_bytes, payload_digest, refers_to_id`` of each record in a folder's WARC files; a revisit's size and digest are those of the full payload."""
    ship(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows = []
                for r in read_warc(name, content):
                    h, kind = r.headers, r.headers["warc-type"]
                    size = int(r.http_headers.get("content-length", 0)) if kind == "revisit" else len(r.payload)
                    page = r.http_headers.get("x-page-id")
                    rows.append((h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], None if page is None else int(page), size, h["warc-payload-digest"].removeprefix("sha256:"), h.get("warc-refers-to")))
                yield pd.DataFrame(rows, columns=["record_id", "record_type", "url", "date", "page_id", "payload_bytes", "payload_digest", "refers_to_id"]).astype({"page_id": "Int64"})

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", "content").mapInPandas(run, "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string")


def pages_through_warc(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each row of ``pages``, read back from WARC files that the converter wrote.

    ``refers_to``: the page id of a revisit's response, found by its record id. Null html is an empty
    payload; payloads under ``least`` bytes are all responses. A null page id stays null and never is
    the smallest unless all are null; such records are all responses then. Repeated rows each have a
    record. An empty table gives no rows.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "pages")
    folder = f"{ws.path}/archives"
    # Written, so that places in archives, and with them record ids, are the same in both of the converter's passes.
    convert(ws.table(pages_as_arc(pages), "arc"), folder, least)
    records = ws.table(read_folder(spark, folder), "records")
    answered = records.where("record_type = 'response'").select(F.col("record_id").alias("__id"), F.col("page_id").alias("refers_to")).dropDuplicates(["__id"])
    wanted = records.where("refers_to_id is not null").select(F.col("refers_to_id").alias("__id")).distinct()
    answered = answered.join(wanted, "__id", "left_semi")
    return records.join(lookup(answered), F.col("refers_to_id") == F.col("__id"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
