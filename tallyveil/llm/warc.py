"""Legacy ARC archives to WARC archives, and both of them written and read by Spark.

An archive is one gzip file of at most ``ARCHIVE`` bytes before compression (more only if a single record is larger), so
a task holds one archive at a time. Writers go through Spark's text sink, whose line separator is what ends a record in
either format, so files appear only with their committed tasks and in any store that Spark writes to.

ARC: the first block names the version and the fields of the header lines, five in version 1, ten in version 2; each
record has such a line and as many bytes as its last field declares. Conversion keeps address, URI and bytes and derives
the rest: record ids as name-based UUIDs of archive name and offset, ISO timestamps from 14 digits, types (``warcinfo``
for the first block, ``response`` for HTTP messages, ``resource`` for others), SHA-1 digests of block and payload.
Of equal payloads of at least ``least`` bytes, the record with the largest page id is a response and the others become
revisits of it; the choice is pre-aggregated by digest and only revisits travel to the archives, by archive.

Results: a null page is an empty payload, a null URL ``about:blank``, white space in URLs is percent-encoded. Records
without a page id are always responses. Rows repeated with the largest page id of their payload are all responses. A
truncated archive or one whose declared lengths do not fit raises an error. An empty table writes no archive and reads
back as no rows.
"""

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm.common import shared_folder, stored

ARCHIVE = 8 << 20
#: Payloads below this many bytes are never revisits.
LEAST = 1_000
DATE = "20240101000000"

#: The fields of the header lines of both versions, and the profile of revisits.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:archive-records")
_UNSAFE = re.compile(r"[\s\x00-\x20\x7f]")
_PAGE = re.compile(rb"(?im)^X-Page-Id: (-?\d+)\r$")
_LENGTH = re.compile(rb"(?im)^Content-Length: (\d+)\r$")


def _text_row(parts: list[bytes], cut: int) -> pa.RecordBatch:
    """One string of all parts without the last ``cut`` bytes, which the sink adds. The bytes pass unchecked."""
    data = b"".join(parts)[:-cut]
    column = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([column], names=["value"])


def _write(rows: DataFrame, path: str, end: str) -> None:
    """Each row a file. The fastest compression level does for text."""
    rows.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each archive below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


# ---- ARC


def _first_block(name: str, version: int) -> bytes:
    body = f"{version} 0 pages\n{FIELDS[version]}\n".encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {middle}{len(body)}\n".encode() + body + b"\n"


def _arc_rows(prefix: str, version: int | None):
    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size = 0

        def start():
            nonlocal number, size
            # Without a version asked for, archives take both in turn.
            kind = version or 1 + (part + number) % 2
            name = f"{prefix}-{part:06d}-{number:06d}.arc"
            parts[:] = [_first_block(name, kind)]
            number, size = number + 1, len(parts[0])
            return name, kind

        name, kind = None, 1
        for batch in batches:
            pages, urls, htmls = batch.column("page"), batch.column("url"), batch.column("html")
            for i in range(batch.num_rows):
                if name is None:
                    name, kind = start()
                html = htmls[i].as_buffer() if htmls[i].is_valid else b""
                page = f"X-Page-Id: {pages[i].as_py()}\r\n" if pages[i].is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(html)}\r\n\r\n".encode()
                url = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), urls[i].as_py() or "about:blank")
                middle = "" if kind == 1 else f"200 - - {size} {name} "
                line = f"{url} 0.0.0.0 {DATE} text/html {middle}{len(head) + len(html)}\n".encode()
                parts += [line, head, bytes(html), b"\n"]
                size += len(line) + len(head) + len(html) + 1
                if size >= ARCHIVE:
                    yield _text_row(parts, 1)
                    name = None
        if name is not None:
            yield _text_row(parts, 1)

    return run


def write_arc(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", version: int | None = None) -> None:
    """Pages as ARC archives of one version, or of both in turn. Each record is an HTTP message."""
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    _write(rows.mapInArrow(_arc_rows("pages", version), "value string"), path, "\n")


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an archive's bytes: fields by name, offset, version and body; the first is the version block."""
    at, names, version = 0, [], 0
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end]
        length = int(line[line.rindex(b" ") + 1 :])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length or data[end + 1 + length : end + 2 + length] not in (b"\n", b""):
            raise ValueError(f"the record at byte {at} does not have the declared {length} bytes")
        if not at:
            head = body.split(b"\n")
            version, names = int(head[0].split()[0]), head[1].decode().split(" ")
            if " ".join(names) != FIELDS.get(version):
                raise ValueError(f"unknown fields of version {version}: {names}")
        fields = dict(zip(names, line.decode().rsplit(" ", len(names) - 1)))
        yield {"offset": at, "version": version, "fields": fields, "body": body}
        at = end + 2 + length


def _parts_of(message: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload, of an HTTP message; other content is all payload."""
    if not message.startswith(b"HTTP/"):
        return b"", message
    cut = message.find(b"\r\n\r\n")
    return (message, b"") if cut < 0 else (message[: cut + 4], message[cut + 4 :])


def _record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{archive} {offset}')}>"


def _moment(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _payloads(batches):
    """What the choice of revisits needs of each record."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            out = []
            archive = ""
            for record in parse_arc(gzip.decompress(content.as_buffer())):
                fields = record["fields"]
                if not record["offset"]:
                    archive = fields["URL"].removeprefix("filedesc://")
                    continue
                head, payload = _parts_of(record["body"])
                page = _PAGE.search(head)
                out.append((path.as_py(), record["offset"], int(page[1]) if page else None, len(payload), hashlib.sha1(payload).digest(), _record_id(archive, record["offset"]), fields["URL"], _moment(fields["Archive-date"])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PAYLOADS.values())], names=list(_PAYLOADS))


_PAYLOADS = {"path": pa.string(), "offset": pa.int64(), "page": pa.int64(), "bytes": pa.int64(), "sha1": pa.binary(), "record": pa.string(), "uri": pa.string(), "date": pa.string()}

# ---- WARC


def _warc_record(kind: str, fields: dict, block: bytes) -> list[bytes]:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return ["\r\n".join(lines).encode() + b"\r\n\r\n", block, b"\r\n\r\n"]


def _converted(batches):
    """Each ARC archive as one WARC archive."""
    for batch in batches:
        for content, revisits in zip(batch.column("content"), batch.column("revisits")):
            of = {r["offset"]: r for r in revisits.as_py() or ()}
            parts: list[bytes] = []
            archive = ""
            for record in parse_arc(gzip.decompress(content.as_buffer())):
                fields, body, at = record["fields"], record["body"], record["offset"]
                if not at:
                    archive = fields["URL"].removeprefix("filedesc://")
                    note = f"software: converted from ARC version {record['version']}\r\nformat: WARC File Format 1.1\r\n".encode()
                    parts += _warc_record("warcinfo", {"WARC-Record-ID": _record_id(archive, 0), "WARC-Date": _moment(fields["Archive-date"]), "WARC-Filename": archive, "Content-Type": "application/warc-fields"}, note)
                    continue
                head, payload = _parts_of(body)
                made = {"WARC-Record-ID": _record_id(archive, at), "WARC-Date": _moment(fields["Archive-date"]), "WARC-Target-URI": fields["URL"], "WARC-IP-Address": fields["IP-address"], "WARC-Payload-Digest": _digest(payload)}
                made["Content-Type"] = "application/http; msgtype=response" if head else fields["Content-type"]
                if at in of:
                    first = of[at]
                    made |= {"WARC-Profile": PROFILE, "WARC-Refers-To": first["record"], "WARC-Refers-To-Target-URI": first["uri"], "WARC-Refers-To-Date": first["date"], "X-Refers-To-Page": first["page"]}
                    parts += _warc_record("revisit", made, head)
                else:
                    parts += _warc_record("response" if head else "resource", made | {"WARC-Block-Digest": _digest(body)}, body)
            if parts:  # Spark writes an empty file for an empty table
                yield _text_row(parts, 4)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> None:
    """The ARC archives of a folder as WARC archives in another."""
    schema = "path string, offset long, page long, bytes long, sha1 binary, record string, uri string, date string"
    seen = stored(_files(spark, arc_path).mapInArrow(_payloads, schema), "payloads")
    able = seen.filter((F.col("bytes") >= least) & F.col("page").isNotNull())
    groups = able.groupBy("sha1").agg(F.max(F.struct("page", "record", "uri", "date")).alias("first"), F.min("page").alias("lowest"))
    groups = stored(groups.filter(F.col("lowest") < F.col("first.page")).drop("lowest"), "originals")
    later = able.join(groups, "sha1").filter(F.col("page") < F.col("first.page"))
    revisits = later.select("path", F.struct("offset", "first.page", "first.record", "first.uri", "first.date").alias("r"))
    # At most the records of one archive meet in a list.
    revisits = stored(revisits.groupBy("path").agg(F.collect_list("r").alias("revisits")), "revisits")
    rows = _files(spark, arc_path).join(revisits, "path", "left").select("content", "revisits")
    _write(rows.mapInArrow(_converted, "value string"), warc_path, "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Fields and block of each record of an archive's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not have the declared {length} bytes")
        yield fields, block
        at = end + 8 + length


def _read_back(batches):
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for fields, block in parse_warc(gzip.decompress(content.as_buffer())):
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                head, payload = _parts_of(block)
                digest = fields["WARC-Payload-Digest"]
                if kind != "revisit" and digest != _digest(payload):
                    raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have the declared digest")
                page, length = _PAGE.search(head), _LENGTH.search(head)
                size = int(length[1]) if kind == "revisit" and length else len(payload)
                to = fields.get("X-Refers-To-Page")
                out.append((int(page[1]) if page else None, size, base64.b32decode(digest[5:]).hex(), kind, int(to) if to else None, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], fields["WARC-Date"], payload if kind != "revisit" else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RECORDS.values())], names=list(_RECORDS))


_RECORDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "refers_to_id": pa.string(), "uri": pa.string(), "date": pa.string(), "payload": pa.binary()}


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder's archives, checked against their digests; ``payload`` false leaves the bytes out."""
    kept = {k: t for k, t in _RECORDS.items() if payload or k != "payload"}
    schema = ", ".join(f"{k} {'long' if t == pa.int64() else t}" for k, t in kept.items())

    def run(batches):
        for rows in _read_back(batches):
            yield rows.select(list(kept))

    return _files(spark, path).mapInArrow(run, schema)


def op2(spark, sf_dir):
    """Pages written as ARC archives, converted to WARC archives and read back."""
    arcs, warcs = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arcs)
    convert(spark, arcs, warcs)
    return read_warc(spark, warcs, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""
