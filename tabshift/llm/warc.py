"""WARC archives of pages, written and read back as a chunked record table.

A task writes its pages into gzip members, one a record, and starts a new file beyond
`ARCHIVE_BYTES`. Files have names of their own for each attempt and only the manifest of
finished tasks names them, so a lost executor leaves nothing that is read. Reading streams a
file through a fixed buffer: a payload comes out as rows of (record_id, chunk) with at most
`CHUNK_BYTES`, each with the bytes and the SHA-1 so far; the last one carries the whole
payload's. No record is ever held in memory as a whole by the reader.

Of records with equal payloads of at least `REVISIT_BYTES`, the one with the largest id is
the response and the others are revisits, which hold the HTTP header alone and name the
response. Digests are compared in Spark, never gathered.

Defined cases: a null payload is empty; a null url is empty; repeated rows with the largest
id are all responses; a null id is smaller than any other. Archives go to the shared folder
through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import column, map_arrow, slices, written
from tabshift.session import shared_folder

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 30
REVISIT_BYTES = 1000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """id, url, payload, size, digest, refers_to (null for a response)."""
    rows = pages.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    long_ = rows.filter(F.col("size") >= least)
    groups = (
        long_.groupBy("digest", "size").agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    ).select("digest", "size", "response")
    refers = F.when(~F.col("response").eqNullSafe(F.col("id")), F.col("response"))
    return rows.join(groups, ["digest", "size"], "left").select(
        "id", "url", "payload", "size", "digest", refers.alias("refers_to")
    )


# ---------------------------------------------------------------- writing


def _urn(value: str | None) -> str:
    return f"<urn:page:{quote(value or '', safe='')}>"


def _heads(id: str | None, url: str | None, size: int, digest: str, refers: str | None) -> tuple[bytes, bytes]:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = len(http) + (size if refers is None else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers)}"]
    return "\r\n".join([*lines, f"Content-Length: {block}", "", ""]).encode(), http


def _write_record(out, row: dict) -> int:
    head, http = _heads(row["id"], row["url"], row["size"], row["digest"], row["refers_to"])
    gz, n = zlib.compressobj(1, zlib.DEFLATED, 31), 0
    payload = memoryview(row["payload"]) if row["refers_to"] is None else memoryview(b"")
    parts = [head, http, *(payload[a : a + CHUNK_BYTES] for a in range(0, len(payload), CHUNK_BYTES)), b"\r\n\r\n"]
    for raw in (*map(gz.compress, parts), gz.flush()):
        n += out.write(raw) or len(raw)
    return n


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records; the manifest (path, records) once all are written."""
    rows = records.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string"), "payload": F.col("payload").cast("binary")})

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out = path = None
        n = size = 0
        for part in slices(batches, "payload"):
            for k in range(part.num_rows):
                if out is None:
                    path = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = system.open_output_stream(path, compression=None), 0, 0
                size += _write_record(out, {c: column(part, c)[k].as_py() for c in part.schema.names})
                n += 1
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return written(map_arrow(rows, run, "path string, records bigint"))


# ---------------------------------------------------------------- reading


def _head(stream: io.BufferedReader) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _chunks(stream: io.BufferedReader, chunk_bytes: int) -> Iterator[dict]:
    """Rows of one archive."""
    while True:
        first = stream.readline()
        if not first:
            return
        if first == b"\r\n":
            continue
        head = _head(stream)
        left = int(head["content-length"])
        before = stream.tell()
        status = stream.readline()
        http = _head(stream) if status else {}
        left -= stream.tell() - before
        revisit = head["warc-type"] == "revisit"
        sha, seen, chunk = hashlib.sha1(), 0, 0
        row = {
            "record_id": unquote(head["warc-record-id"][len("<urn:page:") : -1]),
            "record_type": head["warc-type"],
            "url": unquote(head.get("warc-target-uri", "")),
            "refers_to": unquote(head["warc-refers-to"][len("<urn:page:") : -1]) if revisit else None,
        }
        stated = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise OSError(f"record {row['record_id']} ends early")
            left -= len(data)
            seen += len(data)
            sha.update(data)
            last = left == 0
            if last and not revisit and sha.hexdigest() != stated:
                raise OSError(f"record {row['record_id']} does not match its digest")
            yield row | {
                "chunk": chunk,
                "data": data,
                "last": last,
                "bytes_so_far": int(http["content-length"]) if revisit else seen,
                "digest_so_far": stated if revisit else sha.hexdigest(),
            }
            chunk += 1
            if last:
                break


CHUNK_ROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("refers_to", pa.string()),
        ("chunk", pa.int32()),
        ("data", pa.binary()),
        ("last", pa.bool_()),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
    ]
)


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of all archives in the manifest."""
    # a task for each archive; without a number few paths would be merged into one task
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")

    def run(batches):
        system, _ = fs.FileSystem.from_uri(folder)
        for part in batches:
            for path in column(part, "path").to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as raw, gzip.open(raw) as stream:
                    for row in _chunks(stream, chunk_bytes):
                        rows.append(row)
                        size += len(row["data"]) + 200
                        if size >= 4 * chunk_bytes:
                            yield pa.RecordBatch.from_pylist(rows, CHUNK_ROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CHUNK_ROW)

    schema = "record_id string, record_type string, url string, refers_to string, chunk int, data binary, last boolean, bytes_so_far bigint, digest_so_far string"
    return map_arrow(files, run, schema)


def archive_pages(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> tuple[DataFrame, str]:
    """Writes all pages; the manifest and the folder of the archives."""
    folder = shared_folder(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    rows = pages.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload")
    )
    return write_archives(with_revisits(rows), folder), folder


def archived_records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives, reads them back, and gives one row per record."""
    manifest, folder = archive_pages(pages, id, url, payload)
    kind = pages.schema[id].dataType
    as_id = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return read_archives(manifest, folder).filter("last").select(
        as_id("record_id").alias(id),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"),
        "record_type",
        as_id("refers_to").alias("refers_to"),
        "url",
    )
