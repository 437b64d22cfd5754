"""Operator 2: WARC archives with a splittable reader.

Writing: every page becomes one WARC/1.1 record in a gzip member of its own. Among records with equal payloads of at least
`min_bytes` bytes the one with the smallest id is the response; the others are revisit records without a payload that
refer to it. Tasks write archives of their own under fresh names through the file system that the folder's address names;
only archives of tasks that ended well are listed in the returned manifest, so retries and lost executors leave no trace
in the result.

Reading: archives are cut into byte ranges, one row each. A task looks for the gzip magic from the start of its range,
accepts a candidate only if it inflates, with a correct checksum, to a WARC header, and owns the records that start inside
its range, reading past the end for the last one. Reading goes on at the end of an accepted member; a rejected candidate
moves the search by one byte.

Defined results: a null html is the empty payload; null page ids are kept as null and never are the smallest id while
another page has the payload; rows that repeat the smallest id with the same payload are responses all; an empty table
gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from functools import partial

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, shared_dir, table

ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES = 128 << 20, 8 << 20, 1 << 18
MAGIC = b"\x1f\x8b\x08"
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _file_system(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (pafs.LocalFileSystem(), address)


def encode_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress(head + block + b"\r\n\r\n") + gz.flush()


def decode_record(raw: bytes) -> tuple | None:
    """The fields of RECORDS, or None if raw is no record of ours."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    number = lambda k: None if (v := field[k].removeprefix("<urn:page:").removesuffix(">")) == "null" else int(v)
    kind, url = field["warc-type"], field.get("warc-target-uri")
    block = rest[: int(field["content-length"])]
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(field["warc-payload-length"])):
        raise ValueError(f"record {field['warc-record-id']}: the payload read does not have its digest")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return number("warc-record-id"), url, kind, number("warc-refers-to") if kind == "revisit" else None, int(field["warc-payload-length"]), digest, payload


def _write(folder: str, batches):
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    out, name, size, n = None, "", 0, 0
    for b in pieces(batches, "html"):
        for page_id, url, html, sha1, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to", "revisit")), strict=True):
            if out is None:
                name = f"pages-{uuid.uuid4().hex}.warc.gz"
                out, size, n = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            size += out.write(encode_record(page_id, url, html.encode(), digest, refers_to, revisit))
            n += 1
            if size >= ARCHIVE_BYTES:
                out.close()
                out = None
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) into archives below folder; returns the manifest (path, bytes, records)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("n"))
    narrow = rows.where(F.col("n") >= min_bytes).select("page_id", "sha1")
    first = narrow.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL")
    revisits = narrow.join(first.drop("copies"), "sha1").where("NOT page_id <=> refers_to").select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), "refers_to").distinct()
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
    marked = marked.select("page_id", "url", "html", "sha1", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return materialize(marked.mapInArrow(partial(_write, folder), MANIFEST), "warc-manifest")


class _Bytes:
    """Random access to a file through one read-ahead buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, pos: int, want: int) -> bytes:
        if not (self.base <= pos and pos + want <= self.base + len(self.data)):
            self.file.seek(pos)
            self.base, self.data = pos, self.file.read(min(max(want, READ_BYTES), self.size - pos))
        return self.data[pos - self.base : pos - self.base + want]


def inflate(data: _Bytes, pos: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at pos, if it holds a WARC record."""
    gz, out, at = zlib.decompressobj(31), [], pos
    try:
        while not gz.eof:
            chunk = data.at(at, min(1 << 15, data.size - at))
            if not chunk:
                return None  # cut off
            out.append(gz.decompress(chunk))
            at += len(chunk)
            if len(out) == 1 and not out[0].startswith(b"WARC/1."[: max(1, len(out[0]))]):
                return None
    except zlib.error:
        return None
    raw = b"".join(out)
    return (raw, at - len(gz.unused_data)) if raw.startswith(b"WARC/1.") else None


def records_in(data: _Bytes, start: int, end: int):
    """The records whose members start in [start, end)."""
    pos = start
    while pos < end:
        window = data.at(pos, min(READ_BYTES, end + len(MAGIC) - 1 - pos, data.size - pos))
        found = window.find(MAGIC)
        if found < 0:
            pos += max(1, len(window) - len(MAGIC) + 1)
            continue
        pos += found
        if pos >= end:
            return
        member = inflate(data, pos)
        record = member and decode_record(member[0])
        if record:
            yield record
            pos = member[1]
        else:
            pos += 1


def _read(payloads: bool, batches):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in batches:
        for path, size, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start", "end")), strict=True):
            system, name = _file_system(path)
            rows, held = [], 0
            with system.open_input_file(name) as f:
                for r in records_in(_Bytes(f, size), start, end):
                    rows.append(r if payloads else (*r[:-1], None))
                    held += len(r[-1] or b"") if payloads else 200
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives in manifest (path, bytes), read by byte ranges."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    n = max(1, min(ranges.count(), 50_000))
    return ranges.repartition(n, "path", "start").mapInArrow(partial(_read, payloads), RECORDS)


def op2_warc_splittable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back; equal payloads of any size become revisits."""
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
