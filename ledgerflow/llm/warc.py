"""Legacy ARC archives converted to WARC archives, and WARC archives read back.

An ARC archive begins with a version block, whose version says which fields the header lines
have. A record is one header line and as many bytes as the line's last field declares, so the
records of an archive follow each other by their lengths. Archives may be plain, compressed as a
whole or record by record. The converter parses them, then synthesises what WARC asks for: a record id, an ISO timestamp, the record type and base32 SHA-1 digests of
block and payload. Records with equal payloads become revisits of the one with the smallest
key. Nulls: a null body is empty, a null URL is written as ``-``, and a record without a key has
none in either archive: it is a response, since only keys can be referred to. Repeated rows with
the same key are written once each; those that carry the smallest key of their payload are responses.
Very long bodies are whole records; an empty table gives no rows; other columns are ignored.

Archives are written by Spark's text writer: every record ends with two CRLF, which is the
writer's separator, so the files are WARC as they stand and any file system Spark knows will
do. They are gzip files that end once ``FILE_BYTES`` are reached, so a file, which is read back
whole, holds at most that and one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.tables import fresh_path

FILE_BYTES = 16_000_000
ARCHIVE_BYTES = 4_000_000
KEY_HEADER = b"X-Archive-Key:"
END = b"\r\n\r\n"

# The fields of an ARC header line by version, and the WARC revisit profile.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = "record_id string, page_id long, url string, date string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_arc(record: bytes, version: int) -> tuple[dict[str, str], bytes]:
    """(header fields, body) of one ARC record; the body has the declared length."""
    line, _, rest = record.partition(b"\n")
    fields = ARC_FIELDS[version]
    # Only the URL may hold spaces, so the line is read from its end.
    values = line.decode().rsplit(" ", len(fields) - 1)
    if len(values) != len(fields):
        raise ValueError(f"not a version {version} ARC header line: {line[:200]!r}")
    head = dict(zip(fields, values, strict=True))
    length = int(head["length"])
    if length > len(rest):
        raise ValueError(f"{len(rest)} bytes where {length} are declared")
    return head, rest[:length]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of every record of an ARC archive after its version block."""
    if data[:2] == b"\x1f\x8b":
        plain, rest = [], data
        while rest:  # one gzip member, or one per record
            member = zlib.decompressobj(31)
            plain.append(member.decompress(rest) + member.flush())
            rest = member.unused_data
        data = b"".join(plain)
    if not data.startswith(b"filedesc://"):
        raise ValueError(f"no ARC version block: {data[:80]!r}")
    line, _, rest = data.partition(b"\n")
    version = int(rest.split(b" ", 1)[0])
    at = len(line) + 1 + int(line.rsplit(b" ", 1)[1])
    while at < len(data):
        if data[at : at + 1] in b"\r\n":  # the line end after a body
            at += 1
            continue
        stop = data.index(b"\n", at)
        length = int(data[at:stop].rsplit(b" ", 1)[1])
        yield parse_arc(data[at : stop + 1 + length], version)
        at = stop + 1 + length


def version_block(version: int, date: str) -> bytes:
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 ledgerflow\n{fields[version]}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 pages.arc"
    return f"filedesc://pages.arc 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(content) ARC archives of web pages, in turn of either version, gzip per record in every
    other pair, each closed once ``archive_bytes`` are reached.

    The body is an HTTP response that names the page's key. Line breaks in URLs, which a header
    line cannot hold, are escaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, parts = 0, 0, []

        def packed(part: bytes) -> bytes:
            return gzip.compress(part, 1, mtime=0) if turn % 4 > 1 else part

        for batch in batches:
            for at in range(batch.num_rows):
                page, where, body = (batch.column(c)[at].as_py() for c in range(3))
                version = turn % 2 + 1
                if not parts:
                    parts.append(packed(version_block(version, date)))
                body = (body or "").encode()
                named = b"" if page is None else KEY_HEADER + b" %d\r\n" % page
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + named + b"Content-Length: %d" % len(body) + END + body
                where = (where or "-").replace("\r", "%0D").replace("\n", "%0A")
                extra = "" if version == 1 else " 200 - - 0 pages.arc"
                line = f"{where} 0.0.0.0 {date} text/html{extra} {len(block)}\n".encode()
                parts.append(packed(line + block + b"\n"))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])
                    turn, held, parts = turn + 1, 0, []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    chosen = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return chosen.mapInArrow(run, "content binary")


def read_arc(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row per record of ARC archives, given as a column of their bytes, as Spark's
    ``binaryFile`` source reads them: key, url, ip, date, type, body, digest, size.

    Digest and size are those of the payload after the HTTP headers; the key is the one that
    the headers name, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("url", "ip", "date", "type")] + [("key", pa.int64()), ("body", pa.binary()), ("digest", pa.string()), ("size", pa.int64())])
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for head, body in parse_archive(data.as_buffer().to_pybytes()):
                    http, _, payload = body.partition(END)
                    named = [line for line in http.split(b"\r\n") if line.startswith(KEY_HEADER)]
                    key = int(named[0].partition(b":")[2]) if named else None
                    rows.append({**{c: head[c] for c in ("url", "ip", "date", "type")}, "key": key, "body": body, "digest": sha1_base32(payload), "size": len(payload)})
                    held += len(body)
                    if held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(content).mapInArrow(run, "url string, ip string, date string, type string, key long, body binary, digest string, size long")


def warc_record(head: dict[str, str], body: bytes, key: int | None, refers_to: int | None) -> bytes:
    """The WARC record equivalent to an ARC record, without its closing CRLFs.

    The body is an HTTP response; a revisit keeps its HTTP headers and leaves out the payload.
    """
    http, _, payload = body.partition(END)
    digest = sha1_base32(payload)
    block = body if refers_to is None else http + END
    d = head["date"].ljust(14, "0")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_uuid(key, digest)}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {head['url']}",
        f"WARC-IP-Address: {head['ip']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Identified-Payload-Type: {head['type']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if key is not None:
        lines.append(f"Archive-Key: {key}")
    if refers_to is not None:
        lines += [
            f"WARC-Profile: {REVISIT}",
            f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to, digest)}>",
            f"Archive-Refers-To-Key: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + END + block


def record_uuid(key: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{key}:{digest}")


def with_first_copy(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: the smallest key with the same payload, null for that record itself,
    for records without a key and for payloads below ``least_bytes``.

    Only payloads that occur twice or more reach the join, as (digest, key) rows, so the
    bodies are not shuffled while those fit the planner's broadcast limit; beyond it the join
    is on the digest and its skewed partitions are split.
    """
    # Payload size belongs to the digest key: equal payloads have equal sizes.
    firsts = (
        records.filter(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
        .filter("first_key < last_key")
        .select("digest", "first_key")
    )
    refers = F.when(F.col("first_key") < F.col("key"), F.col("first_key"))
    return records.join(firsts, "digest", "left").withColumn("refers_to", refers)


def as_text(data: bytes) -> pa.RecordBatch:
    """Bytes as they are in a column of text; old archives are not always UTF-8."""
    column = pa.array([data], pa.binary())
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), 1, column.buffers())], names=["value"])


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Convert the rows of ``read_arc`` with ``refers_to`` and write them as WARC files under ``path``.

    A row handed to the text writer is a run of records that holds ``file_bytes`` at most, or one
    record; a file holds one row."""
    fields = ["url", "ip", "date", "type", "key", "body", "refers_to"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for rows in batches:
            for at in range(rows.num_rows):
                *head, key, body, refers_to = (rows.column(c)[at].as_py() for c in range(7))
                made.append(warc_record(dict(zip(fields[:4], head, strict=True)), body, key, refers_to))
                held += len(made[-1])
                if held >= file_bytes:
                    yield as_text(END.join(made))
                    made, held = [], 0
        if made:
            yield as_text(END.join(made))

    (
        records.select(*fields)
        .mapInArrow(convert, "value string")
        .write.option("lineSep", END.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        begin = stop + len(END)
        at = begin + int(head["content-length"])
        yield head, data[begin:at]
        if data[at : at + 4] != END:
            raise ValueError(f"record before byte {at} does not end where it declares")
        at += 4


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; digests are made anew from the
    payload read, and ``intact`` says whether block and payload agree with the headers.
    A revisit has no payload; its size comes from its HTTP headers."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())]
        )
        for batch in batches:
            for content in batch.column(0):
                data = zlib.decompress(content.as_buffer(), 47)
                rows = []
                for head, block in parse_warc(data):
                    http, _, payload = block.partition(END)
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    revisit = head["warc-type"] == "revisit"
                    size = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0]) if revisit else len(payload)
                    digest = stated if revisit else sha1_base32(payload)
                    rows.append(
                        {
                            "record_id": head["warc-record-id"],
                            "page_id": int(head["archive-key"]) if "archive-key" in head else None,
                            "url": head["warc-target-uri"],
                            "date": head["warc-date"],
                            "record_type": head["warc-type"],
                            "refers_to": int(head["archive-refers-to-key"]) if revisit else None,
                            "payload": None if revisit or not payloads else payload,
                            "payload_bytes": size,
                            "payload_digest": digest,
                            "intact": digest == stated and head["warc-block-digest"] == "sha1:" + sha1_base32(block),
                        }
                    )
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, READ_SCHEMA)


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Convert ``pages``, as ARC archives, to WARC archives under ``path`` (a fresh shared folder
    if none is named) and return their records as read back. An empty table gives no rows."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(with_first_copy(read_arc(arc_archives(pages)), least_bytes), path)
    return read_warc(spark, path, payloads=False)
