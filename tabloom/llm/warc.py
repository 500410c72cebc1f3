"""Web archives: writing with revisits for repeated payloads, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import map_arrow, stored
from tabloom.session import work_folder

# fixed values of the archive format
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

ARCHIVE_BYTES = 1 << 30      # an archive is closed once it is larger
READ = 1 << 18               # bytes read at a time
HEAD_BYTES = 1 << 20         # a longer record header counts as damage
FLUSH = 16 << 20             # bytes of payload handed to Spark at a time
MANIFEST = "path string, records bigint, bytes bigint"
COLUMNS = ("path string, offset bigint, length bigint, kind string, reason string, record_type string, record_id string, "
           "target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary")


def _open(path: str, write: bool = False):
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    if write:
        store.create_dir(name.rpartition("/")[0], recursive=True)
        return store.open_output_stream(name, compression=None)    # by default it compresses names in .gz
    return store.open_input_file(name)


def digest(data: bytes) -> str:
    """Base32 of the SHA-1, as archives write it."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(row: dict, date: str) -> bytes:
    """One record: a response with its payload, or, with ``refers_to``, a revisit with the response's HTTP head only."""
    payload = row["payload"] or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row['refers_to'] else 'response'}",
             f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"]:
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"])
        lines.append(f"WARC-Target-URI: {uri}")
    if row["refers_to"]:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + END + block + END


def write_archives(records: DataFrame, folder: str, compress: bool = True,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``record_id``, ``target_uri``, ``payload`` and ``refers_to`` as archives below ``folder``.

    Returns the manifest ``path``, ``records``, ``bytes``, already written. Every task attempt writes files of new
    names, and only those of attempts that Spark accepted are in the manifest, so lost executors and repeated tasks
    leave nothing twice. NULL payloads are empty, NULL addresses are left out.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' * compress}", 0, 0
                    out = _open(path, write=True)
                data = record(row, date)
                if compress:
                    data = zlib.compress(data, wbits=31)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size}])

    rows = records.select("record_id", "target_uri", "payload", "refers_to")
    return stored(map_arrow(rows, write, MANIFEST), "archive-manifest")


class Damaged(ValueError):
    """What stands at this place is no valid record."""


@dataclass
class Found:
    kind: str
    offset: int
    length: int
    reason: str | None = None
    head: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def _checked(head: dict[str, str], block: bytes) -> None:
    """Raises ``Damaged`` if a SHA-1 that the head names isn't that of the block or payload."""
    named = {"warc-block-digest": block}
    if head.get("warc-type") == "response":
        named["warc-payload-digest"] = block.partition(END)[2]
    for name, data in named.items():
        if (said := head.get(name, "")).startswith("sha1:") and said[5:] != digest(data):
            raise Damaged(f"{name} differs")


class Archive:
    """Records of one archive, plain or with a gzip member per record, and the gaps between them."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.packed = self._at(0, 3) == MEMBER

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(min(n, max(0, self.size - offset)))

    def _head(self, data: bytes) -> tuple[dict[str, str], int]:
        if not VERSION.match(data):
            raise Damaged("no version line")
        end = data.find(END)
        if end < 0:
            raise Damaged("head without end")
        head = {}
        for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise Damaged("head line without colon")
            head[name.strip().lower()] = value.strip()
        if not head.get("content-length", "").isascii() or not head.get("content-length", "").isdigit():
            raise Damaged("no content length")
        return head, end + len(END)

    def _plain(self, offset: int) -> Found:
        head, start = self._head(self._at(offset, HEAD_BYTES))
        n = int(head["content-length"])
        if offset + start + n + len(END) > self.size:
            raise Damaged("cut off")
        block = self._at(offset + start, n + len(END))
        if not block.endswith(END):
            raise Damaged("no end after the block")
        _checked(head, block := block[:n])
        return Found("record", offset, start + n + len(END), None, head, block)

    def _member(self, offset: int) -> Found:
        unpack, parts, at = zlib.decompressobj(wbits=31), [], offset
        while not unpack.eof:
            data = self._at(at, READ)
            if not data:
                raise Damaged("member cut off")
            try:
                parts.append(unpack.decompress(data))
            except zlib.error as e:
                raise Damaged(f"member: {e}") from None
            if not VERSION.match(b"".join(parts[:1])[:10]) and len(parts[0]) >= 10:
                raise Damaged("member without version line")
            at += len(data)
        data = b"".join(parts)
        head, start = self._head(data)
        n = int(head["content-length"])
        if data[start + n:] != END:
            raise Damaged("member isn't one record")
        _checked(head, block := data[start:start + n])
        return Found("record", offset, at - len(unpack.unused_data) - offset, None, head, block)

    def _next(self, offset: int) -> Found | None:
        """The first valid record that starts at ``offset`` or later."""
        mark = MEMBER if self.packed else b"WARC/1."
        while offset < self.size:
            data = self._at(offset, READ)
            place = data.find(mark)
            while place >= 0:
                try:
                    return (self._member if self.packed else self._plain)(offset + place)
                except Damaged:
                    place = data.find(mark, place + 1)
            offset += max(1, len(data) - len(mark) + 1)
        return None

    def __iter__(self) -> Iterator[Found]:
        offset = 0
        while offset < self.size:
            try:
                found = (self._member if self.packed else self._plain)(offset)
            except Damaged as e:
                found = self._next(offset + 1)
                end = found.offset if found else self.size
                yield Found("gap", offset, end - offset, str(e))
            if found:
                yield found
                offset = found.offset + found.length
            else:
                offset = self.size


def _row(path: str, found: Found) -> dict:
    head, block = found.head, found.block
    row = {"path": path, "offset": found.offset, "length": found.length, "kind": found.kind, "reason": found.reason}
    if found.kind == "gap":
        return row
    http, _, payload = block.partition(END)
    kind = head.get("warc-type")
    length = re.search(rb"\r\ncontent-length:\s*(\d+)", http, re.I) if kind in ("response", "revisit") else None
    row |= {"record_type": kind, "record_id": head.get("warc-record-id", "").strip("<>"), "date": head.get("warc-date"),
            "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    if kind == "response":
        return row | {"payload": payload, "payload_bytes": len(payload)}
    if kind == "revisit":
        return row | {"payload_bytes": int(length[1]) if length else None}
    return row | {"payload": block, "payload_bytes": len(block)}


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Records (``kind`` ``record``) and quarantined stretches of bytes (``gap``) of the archives in column ``path``.

    Version line, head, length, end and SHA-1 digests of each record are checked. After a failure the reader searches
    for the next gzip member or version line that starts a valid record, logs the bytes between with offset, length and
    reason, and goes on from there. Reading is by offset, one record at a time; an archive is the work of one task. The
    payload of a revisit is that of the record it ``refers_to``; ``payload_bytes`` and ``payload_digest`` are those of
    that full payload. NULL paths are skipped; an empty archive has no rows; a missing one fails the job.
    """
    schema = spark.createDataFrame([], COLUMNS).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                with _open(path) as file:
                    rows, size = [], 0
                    for found in Archive(file, file.size()):
                        rows.append(_row(path, found))
                        size += len(found.block) + 200
                        if size > FLUSH:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    paths = paths.select("path").where("path IS NOT NULL")
    return map_arrow(paths.repartition(max(1, paths.count())), read, COLUMNS)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records for pages (``page_id``, ``url``, ``html``): of equal payloads of ``min_bytes`` or more, the one with the
    largest page id is the response and the others refer to it.

    Equal means the same SHA-256. NULL html is an empty payload. Pages without id give way to those with one; where no
    page of a payload has an id, all are responses. Rows that repeat the largest id are all responses.
    """
    rows = pages.select(pages["page_id"], pages["url"].alias("target_uri"),
                        F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    heads = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("same")
             .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 AND head IS NOT NULL"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    joined = rows.join(heads, "same", "left")
    return joined.select(name("page_id").alias("record_id"), "target_uri", "payload", F.when(
        F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), name("head")).alias("refers_to"))


def archived_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives, reads them back, and returns what the archives say of each page.

    Columns: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (page id of the
    response, for revisits). See ``page_records`` for NULLs and repeats. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or work_folder(spark, "archives")
    found = read_archives(spark, write_archives(page_records(pages, min_bytes), folder)).where("kind = 'record'")
    kind = pages.schema["page_id"].dataType.simpleString()
    number = "try_cast(substring({}, 10) AS " + kind + ")"
    return found.select(F.expr(number.format("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.expr(number.format("refers_to")).alias("refers_to"))
