"""WARC archives: written as gzip members, one a record, and read back by byte ranges.

Writing: payloads are compared by SHA-1. Of records with equal payloads the one with the largest
id carries the payload (response); the others are revisits that name it. Each task streams
its rows into files of its own in the shared folder; only files that a finished task reports are
in the manifest, so what a lost executor leaves behind is never read.

Reading: a file is cut at fixed byte offsets. The task of a range looks for the gzip magic,
takes a place for a member only if its first bytes decode to a WARC version line, and owns
the records that start inside its range; it reads past the end to finish the last one. No index and no
first pass over the file are needed.

Defined results: null payload, url or date are empty. A null id is written as `null` and read as null;
it never becomes the response while an equal payload has an id. Rows that repeat both id and payload are one
capture and get the same type. Payloads under `min_bytes` are all responses. An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_path, slices, write_table

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task starts a new file beyond so many bytes.
FILE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
WINDOW = 1 << 18


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: How Spark names stores that are read and written here under another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "dbfs": "file", "wasbs": "abfs", "abfss": "abfs"}


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return pa.fs.LocalFileSystem(), uri
    if scheme in ("file", "dbfs"):  # a mounted store, and local paths with one slash or three
        path = "/" + rest.lstrip("/")
        return pa.fs.LocalFileSystem(), f"/dbfs{path}" if scheme == "dbfs" else path
    return pa.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def _field(value: str) -> str:
    """A value that can't break the header: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else quote(c) for c in value)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out, rest


def captures(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """A row per distinct (id, payload): __id, __sha (hex SHA-1), refers_to (null for responses). No payload moves here."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    seen = pages.select(F.col(id_col).cast("long").alias("__id"), F.sha1(payload).alias("__sha"), F.length(payload).alias("__size")).distinct()
    heads = seen.where(F.col("__size") >= min_bytes).groupBy("__sha").agg(F.max("__id").alias("__head")).withColumnRenamed("__sha", "__of")
    other = F.col("__head").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__head"))
    return seen.join(heads, (F.col("__sha") == F.col("__of")) & (F.col("__size") >= min_bytes), "left").select("__id", "__sha", F.when(other, F.col("__head")).alias("refers_to"))


def _write_batches(folder: str, date: str):
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}], schema=schema)

        for whole in batches:
            for batch in slices(whole, 2):
                for page, url, html, sha, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        path = f"{folder}/{name}"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    raw = record(page, url or "", html or b"", base64.b32encode(bytes.fromhex(sha)).decode(), refers, date)
                    out.write(raw)
                    size, n = size + len(raw), n + 1
                    if size >= FILE_BYTES:
                        yield done()
                        out = None
        if out is not None:
            yield done()

    return run


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row and return the manifest: path, bytes, records of each file."""
    folder = (folder or fresh_path(pages.sparkSession, "warc")).rstrip("/")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), url.alias("url"), payload.alias("html")).withColumn("sha", F.sha1("html"))
    known = captures(pages, id_col, payload_col, min_bytes)
    rows = rows.join(known, F.col("page").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left")
    rows = rows.select("page", "url", "html", "sha", "refers_to")
    return write_table(rows.mapInArrow(_write_batches(folder, date), "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """Buffered reads of a file at any offset."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.size, self.at, self.held = source, source.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.source.seek(at)
            self.at, self.held = at, self.source.read(max(n, WINDOW))
        return self.held[at - self.at : at - self.at + n]


def is_member(window: _Window, at: int) -> bool:
    """Whether a gzip member that holds a WARC record starts here."""
    try:
        return zlib.decompressobj(31).decompress(window.get(at, 4096), 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and decoded bytes of the records that start in [start, end)."""
    window, at = _Window(source), start
    end = min(end, window.size)
    while at < end:
        chunk = window.get(at, min(WINDOW, end - at + len(MAGIC) - 1))
        found = chunk.find(MAGIC)
        if found < 0 or at + found >= end:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += found
        if not is_member(window, at):
            at += 1
            continue
        unpack, parts, p = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                chunk = window.get(p, min(WINDOW, window.size - p))
                if not chunk:
                    raise ValueError(f"the record at byte {at} is cut short")
                parts.append(unpack.decompress(chunk))
                p += len(chunk)
        except zlib.error:
            at += 1  # it only looked like a member
            continue
        yield at, b"".join(parts)
        at = p - len(unpack.unused_data)


def _id_of(value: str | None) -> int | None:
    tail = (value or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_warc(files: DataFrame, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row per record of the files (path, bytes): ids, type, url, sizes, digest, place and, if asked, the payload.

    payload_bytes and payload_digest are of the full payload: computed for responses, where a differing
    digest raises, and declared for revisits.
    """
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("path", pa.string()), ("record_offset", pa.int64())] + payload * [("payload", pa.binary())]
    schema = pa.schema(fields)

    def row(raw: bytes, path: str, at: int) -> dict:
        head, rest = _headers(raw)
        http, body = _headers(rest[: int(head["content-length"])])
        kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            own = base32_sha1(body)
            if digest and own != digest:
                raise ValueError(f"{path} at {at}: the payload doesn't have its digest")
            digest = own
        out = {"page_id": _id_of(head.get("warc-record-id")), "record_type": kind, "refers_to": _id_of(head.get("warc-refers-to")), "url": head.get("warc-target-uri"), "payload_bytes": len(body) if kind == "response" else int(http.get("content-length", 0)), "payload_digest": digest, "path": path, "record_offset": at}
        return out | ({"payload": body if kind == "response" else None} if payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, local = open_store(path)
                with fs.open_input_file(local) as source:
                    rows, held = [], 0
                    for at, raw in members(source, start, start + split_bytes):
                        rows.append(row(raw, path, at))
                        held += len(raw)
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    starts = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, path string, record_offset long" + payload * ", payload binary"
    return starts.repartition(n).mapInArrow(run, kinds)
