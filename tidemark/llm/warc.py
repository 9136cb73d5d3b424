"""WARC archives: a converter for legacy ARC files, a writer with revisit records, a reader.

An ARC file opens with a version block, whose first line after the header names the version; version 1
header lines have five fields (address, IP, date, type, length), version 2 lines ten. A record is its
header line and as many bytes as declared. The converter synthesises what ARC lacks: record identifiers
(UUIDs of address, date and digest, so that another run gives the same), dates, types and digests.

Archives are gzipped record by record and written straight to the shared folder by the tasks that hold
the rows; only files that a task returned are read, so what a lost attempt left behind is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_dir, small

FIELDS = {1: ("uri", "ip", "date", "type", "length"), 2: ("uri", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length")}
#: Payloads shorter than this are stored each time.
LEAST_REVISIT = 1000
#: An archive is closed once it has so many bytes.
FILE_BYTES = 256 << 20
#: Rows of the revisit table up to which it is broadcast (each some 50 bytes); beyond it the pages are shuffled.
BROADCAST_ROWS = 200_000


def arc_header(version: int, uri: str, date: str, kind: str, length: int, ip: str = "0.0.0.0") -> bytes:
    uri = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri) or "-"
    more = ["200", "-", "-", "0", "-"] if version == 2 else []
    return " ".join([uri, ip, date, kind, *more, str(length)]).encode() + b"\n"


def arc_version_block(version: int, name: str = "converted.arc", date: str = "19700101000000") -> bytes:
    names = ("URL", "IP-address", "Archive-date", "Content-type", *(("Result-code", "Checksum", "Location", "Offset", "Filename") if version == 2 else ()), "Archive-length")
    body = f"{version} 0 tidemark\n{' '.join(names)}\n".encode()
    return arc_header(1, f"filedesc://{name}", date, "text/plain", len(body)) + body + b"\n"


def parse_arc(f: BinaryIO) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of each record but the version block, whose version says how lines are read.

    Blank lines between records are skipped. ValueError for lines or lengths that don't fit.
    """
    version = None
    while line := f.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if version is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("no version block")
            block = f.read(int(parts[-1]))
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        names = FIELDS[version]
        if len(parts) < len(names):
            raise ValueError(f"header line of {len(parts)} fields in version {version}")
        # an address with spaces has more parts; the other fields have none
        extra = len(parts) - len(names)
        fields = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]])) | {"version": version}
        length = int(fields["length"])
        block = f.read(length)
        if len(block) != length:
            raise ValueError(f"{len(block)} of {length} bytes declared")
        yield fields, block


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with the empty line, if there is one, and the payload."""
    if block.startswith(b"HTTP/"):
        head, sep, body = block.partition(b"\r\n\r\n")
        if sep:
            return head + sep, body
    return b"", block


def arc_date(date: str) -> str:
    """The WARC form of an ARC date of up to 14 digits; what it lacks is the beginning of its time."""
    return datetime.strptime(date[:14] + "00000101000000"[len(date[:14]) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(fields: dict, digest: str) -> str:
    """A UUID of the record's place (archive and offset, if they are known), address, date and digest, so that another
    run gives the same one and no two records share one but rows equal in page_id, url and html."""
    parts = [str(fields.get("archive", "")), str(fields.get("at", "")), fields["uri"], fields["date"], digest]
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def convert(fields: dict, block: bytes) -> tuple[dict[str, str], bytes]:
    """The WARC headers and block equivalent to an ARC record."""
    head, payload = payload_of(block)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    date = arc_date(fields["date"])
    kind = "response" if head else "metadata" if fields["type"] == "text/anvl" else "resource"
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(fields, digest),
        "WARC-Date": date,
        "WARC-Target-URI": fields["uri"],
        "WARC-Payload-Digest": digest,
        "Content-Type": "application/http; msgtype=response" if head else fields["type"],
    }
    if fields["ip"] not in ("0.0.0.0", "-"):
        headers["WARC-IP-Address"] = fields["ip"]
    return headers, block


def revisit(headers: dict[str, str], block: bytes, refers_to: dict[str, str] | None = None) -> tuple[dict[str, str], bytes]:
    """A response without its payload; digest and HTTP head are those of the full one. `refers_to` has the headers of
    the record that keeps the payload."""
    more = {"WARC-Refers-To": refers_to["WARC-Record-ID"], "WARC-Refers-To-Target-URI": refers_to["WARC-Target-URI"], "WARC-Refers-To-Date": refers_to["WARC-Date"]} if refers_to else {}
    return headers | {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} | more, payload_of(block)[0]


def dump(headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n") + z.flush()


def load(f: BinaryIO, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file gzipped record by record; one record at a time is in memory."""
    rest = b""
    while rest or (rest := f.read(size)):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not rest and not (rest := f.read(size)):
                raise ValueError("the archive ends inside a record")
            parts.append(z.decompress(rest))
            rest = z.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = body[: int(headers["Content-Length"])]
        if len(block) != int(headers["Content-Length"]):
            raise ValueError("a record shorter than declared")
        yield headers, block


def _open(path: str, write: bool = False):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    if write:
        where.create_dir(name.rpartition("/")[0], recursive=True)
    # else Arrow would gzip a .gz file once more
    return where.open_output_stream(name, compression=None) if write else where.open_input_stream(name, compression=None)


def arc_to_warc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """(record_id, record_type, record_date, uri, payload_digest, block) of each record in ARC files given as
    binary rows, gzipped or not. Null and empty contents have no records."""
    schema = "record_id string, record_type string, record_date string, uri string, payload_digest string, block binary"
    names = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest")

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                if not raw:
                    continue
                if raw[:2] == b"\x1f\x8b":
                    parts = []
                    while raw:
                        z = zlib.decompressobj(31)
                        parts.append(z.decompress(raw))
                        raw = z.unused_data
                    raw = b"".join(parts)
                rows = [convert(*r) for r in parse_arc(io.BytesIO(raw))]
                yield pa.RecordBatch.from_arrays([*(pa.array([h[n] for h, _ in rows], pa.string()) for n in names), pa.array([x for _, x in rows], pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    return archives.select(content_col).mapInArrow(run, schema)


def page_date(page: int | None) -> str:
    """Pages carry no date; an ARC record must. A second for each page_id after the year 2000, so that dates tell pages
    apart and another run gives the same."""
    seconds = (0 if page is None else page) % (100 * 365 * 86400)
    return (datetime(2000, 1, 1) + timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")


def page_record(version: int, page: int | None, url: str | None, html: str | None) -> bytes:
    """A page as an ARC record: header line and HTTP response. The page_id stands in the HTTP head."""
    body = (html or "").encode()
    own = b"" if page is None else b"X-Page-Id: %d\r\n" % page
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(body), own) + body
    return arc_header(version, url or "urn:none", page_date(page), "text/html", len(block)) + block + b"\n"


def page_of(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return None if found is None else int(found[1])


def write(pages: DataFrame, directory: str) -> DataFrame:
    """Write (page_id, url, html, refers_to, refers_url) as archives; a written table of (path, records).

    Each batch of rows is first put down as the bytes of an ARC archive (versions 1 and 2 by turns), with its version
    block; these are parsed by header lines and declared lengths, and each record converted. Memory holds one batch.
    """

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        number, out, size, records, path = 0, None, 0, 0, ""
        made: list[tuple[str, int]] = []
        try:
            for k, b in enumerate(small(batches)):
                version = 1 + (context.partitionId() + k) % 2
                rows = list(zip(*(c.to_pylist() for c in b.columns)))
                arc = io.BytesIO(arc_version_block(version) + b"".join(page_record(version, page, url, html) for page, url, html, _, _ in rows))
                for (fields, block), (_, _, _, refers, refers_url) in zip(parse_arc(arc), rows):
                    if out is None:
                        path = f"{directory}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.gz"
                        out, size, records, number = _open(path, True), 0, 0, number + 1
                    page = page_of(payload_of(block)[0])
                    # a page is its own place: its identifier is known to the records that refer to it
                    place = {"archive": "page", "at": page} if page is not None else {"archive": path, "at": records}
                    headers, block = convert(fields | place, block)
                    if refers is not None:
                        line = arc_header(1, refers_url or "urn:none", page_date(refers), "text/html", 0).decode().split(" ")
                        other = {"uri": line[0], "date": line[2], "archive": "page", "at": refers}
                        to = {"WARC-Record-ID": record_id(other, headers["WARC-Payload-Digest"]), "WARC-Target-URI": line[0], "WARC-Date": arc_date(line[2])}
                        headers, block = revisit(headers, block, to)
                        headers["Refers-To-Page-Id"] = str(refers)
                    size += out.write(dump(headers, block))
                    records += 1
                    if size > FILE_BYTES:
                        out.close()
                        made.append((path, records))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            made.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["path", "records"])

    return materialize(pages.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(run, "path string, records long"), "archives")


def read(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the files at `path`."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                with _open(path) as f:
                    for h, block in load(f):
                        head, payload = payload_of(block)
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if h["WARC-Type"] == "revisit":
                            n = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                        else:
                            n = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"digest of {h['WARC-Record-ID']} in {path}")
                        page, refers = page_of(head), h.get("Refers-To-Page-Id")
                        rows.append((page, n, digest, h["WARC-Type"], None if refers is None else int(refers)))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    n = max(1, files.count())
    return files.select("path").repartition(min(n, 10_000)).mapInArrow(run, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as archives, read them back: one row per page.

    Of equal payloads of at least LEAST_REVISIT bytes the largest page_id is the response (repeats of it
    too), the others revisit it. Null html is an empty payload, a row without page_id always a response.
    Other columns are left out; an empty table gives no rows.
    """
    spark = pages.sparkSession
    src = pages.select("page_id", "url", "html")
    body = F.coalesce("html", F.lit("")).cast("binary")
    light = src.where("page_id is not null").select("page_id", "url", F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= LEAST_REVISIT)
    best = light.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.min("page_id").alias("least")).select("digest", F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url"), "least").where("least < refers_to").drop("least")
    again = materialize(light.join(best, "digest").where("page_id < refers_to").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to", "refers_url").distinct(), "revisits")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = src.join(again, (F.col("page_id") == F.col("_page")) & (F.sha1(body) == F.col("_digest")), "left")
    return read(write(rows, new_dir(spark, "warc")))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS w FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < w THEN w END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
