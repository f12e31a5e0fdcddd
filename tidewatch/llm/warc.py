"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is a run of frames and a footer, a skippable frame with the
compressed and plain size of each frame (the public seekable format). The index maps a record's id to its bundle, frame and
offset inside the frame, so one record costs one frame's decompression. Bundles are rows of a Parquet table in the shared
folder: executors write and read them by Spark alone, and a lost task writes its bundles anew. Payloads that occur before are
revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written
from tidewatch.shared import run_dir

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
# Magic numbers of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~', errors='replace')}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-Id: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC fields, HTTP fields, payload, end) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(fields["Content-Length"])
    block = data[start:start + size]
    if data[start + size:start + size + 4] != b"\r\n\r\n":
        raise ValueError("record isn't closed")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload, start + size + 4


def footer(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    at, offset, out = len(bundle) - 9 - 8 * count, 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", bundle, at + 8 * k)
        out.append((offset, packed, plain))
        offset += packed
    return out


def read_frame(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    offset, packed, plain = entry
    return zstandard.ZstdDecompressor().decompress(bundle[offset:offset + packed], max_output_size=plain)


_BUNDLES = pa.schema([("bundle_id", pa.string()), ("content", pa.binary()), ("index", pa.list_(pa.struct(
    [("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
    plain, content, frames, index = bytearray(), bytearray(), [], []

    def end_frame() -> None:
        if plain:
            packed = packer.compress(bytes(plain))
            frames.append((len(packed), len(plain)))
            content.extend(packed)
            plain.clear()

    def end_bundle() -> pa.RecordBatch:
        nonlocal number
        end_frame()
        out = pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}"]), pa.array([bytes(content) + footer(frames)], pa.binary()),
                                          pa.array([index], _BUNDLES.field("index").type)], schema=_BUNDLES)
        number += 1
        content.clear()
        frames.clear()
        index.clear()
        return out

    for batch in batches:
        for page, url, html, digest, refers, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
            page, digest = page.as_py(), digest.as_py()
            made = record(page, url.as_py(), html.as_py() or b"", digest, refers.as_py(), revisit.as_py())
            index.append({"record_id": record_id(page, digest), "frame": len(frames), "offset": len(plain), "length": len(made)})
            plain.extend(made)
            if len(plain) >= FRAME_BYTES:
                end_frame()
                if len(content) >= BUNDLE_BYTES:
                    yield end_bundle()
    if index:
        yield end_bundle()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])
    for batch in batches:
        payloads = [x.as_py() or b"" for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([sha1_base32(x) for x in payloads]), pa.array([len(x) for x in payloads])], schema=schema)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = pa.array([sha1_base32(x.as_py() or b"") for x in batch.column("html")], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, "digest"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write (page_id, url, html) as records in bundles to the table at ``path``.

    Of equal payloads of ``least_bytes`` at least, those of the smallest page_id are responses and the others revisits of it.
    A null html is an empty payload; a null page_id counts as larger than any other; rows with the same page_id and payload are
    records alike. Other columns are not read.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.col("html").cast("string"), "UTF-8").alias("html"))
    digests = written(source.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, size long"), "digests")
    large = digests.filter(F.col("size") >= least_bytes)
    firsts = written(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "first-pages")
    revisits = lookup(large.select("page_id", "digest").distinct(), firsts, ["digest"], "n").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(
        F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to", F.lit(True).alias("revisit"))
    keyed = source.mapInArrow(_with_digest, "page_id long, url string, html binary, digest string")
    joined = keyed.join(revisits, (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page")), "left").select(
        "page_id", "url", "html", "digest", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    joined.mapInArrow(_bundles, "bundle_id string, content binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>").write.option(
        "compression", "none").parquet(path)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("bundle_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])
    for batch in batches:
        for name, content, index in zip(batch.column("bundle_id"), batch.column("content"), batch.column("index"), strict=True):
            bundle, out, open_frame, plain = content.as_py(), [], -1, b""
            table = seek_table(bundle)
            for entry in index.as_py():
                if entry["frame"] != open_frame:
                    open_frame, plain = entry["frame"], read_frame(bundle, table[entry["frame"]])
                fields, http, payload, end = read_record(plain, entry["offset"])
                if fields["WARC-Record-ID"] != entry["record_id"] or end != entry["offset"] + entry["length"]:
                    raise ValueError(f"index and record differ: {entry}")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and sha1_base32(payload) != digest:
                    raise ValueError(f"payload and digest differ: {entry}")
                page, refers = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
                out.append((page and int(page), int(http["Content-Length"]), digest, fields["WARC-Type"], refers and int(refers),
                            name.as_py(), entry["frame"], entry["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def read_archives(bundles: DataFrame) -> DataFrame:
    """One row for each record, read through footer and index: page_id, payload size and digest, type, what it refers to, place."""
    return bundles.mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                                        "bundle_id string, frame int, offset long")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    path = run_dir(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession.read.parquet(path))
