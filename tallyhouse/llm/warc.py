"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is a run of frames with a seek table as its
footer (a skippable frame with the compressed and raw size of each frame, in the seekable format that Zstandard
publishes). An index maps each record to its bundle, frame and offset inside the frame, so one record costs one frame.
Bundles are rows of a Parquet table with a binary column, since Spark writes such tables to any store; the bytes of a
row are a complete .warc.zst file. Payloads of at least min_bytes that occur again are written as revisit records.

Records follow WARC/1.1: a response holds an HTTP message with the payload, a revisit none; every record has a date and an
identifier of its own, and X-Page-ID has the page. A page without an address has urn:page: and its identifier as one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from datetime import datetime, timezone
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import meet, staged

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the table's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLE = "bundle string, data binary, records array<struct<page_id: bigint, frame: int, offset: bigint, length: bigint>>"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _uri(page_id: int | None, url: str | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}" if url is None else "".join(c for c in url if c >= " ")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, refers_to_url: str | None, date: str, name: str) -> bytes:
    """A response record with its payload, or a revisit record (payload None) of the page refers_to. name is the record's own."""
    again = payload is None
    http = b"" if again else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = _header(
        [
            ("WARC-Type", "revisit" if again else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", _uri(page_id, url)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None),
            ("WARC-Refers-To-Target-URI", _uri(refers_to, refers_to_url) if again else None),
            ("WARC-Refers-To-Date", date if again else None),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Page-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("X-Refers-To-Page", f"<urn:page:{refers_to}>" if again else None),
            ("X-Payload-Length", size),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", len(http) + len(payload or b"")),
        ]
    )
    return head + http + (payload or b"") + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple]:
    """(page_id, url, type, refers_to, payload size, digest, payload) of each record in a frame. The payload of a response is hashed again."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        block, at = data[end + 4 : end + 4 + n], end + 4 + n + 4
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"record {fields['WARC-Record-ID']}: its payload does not have its digest")
        page, uri = number(fields["X-Page-ID"]), fields["WARC-Target-URI"]
        url = None if uri == _uri(page, None) else uri
        yield page, url, kind, number(fields["X-Refers-To-Page"]) if kind == "revisit" else None, size, digest, payload


def bundle(frames: list[tuple[bytes, int]]) -> bytes:
    """Compressed frames and their raw sizes as one seekable file."""
    table = b"".join(struct.pack("<II", len(f), raw) for f, raw in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(f for f, _ in frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    at, out, begin = 0, [], len(data) - 9 - n * width
    for i in range(n):
        packed, raw = struct.unpack_from("<II", data, begin + i * width)
        out.append((at, packed, raw))
        at += packed
    return out


def _bundles(batches: Iterator[pa.RecordBatch], frame_bytes: int, bundle_bytes: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    packer, part = zstandard.ZstdCompressor(level=level), TaskContext.get().partitionId()
    frames, index, held, size, count, written = [], [], [], 0, 0, 0

    def close_frame() -> None:
        nonlocal held, size
        raw = b"".join(held)
        frames.append((packer.compress(raw), len(raw)))
        held, size = [], 0

    def close_bundle() -> pa.RecordBatch:
        nonlocal frames, index, count
        out = pa.RecordBatch.from_pylist([{"bundle": f"{part:06d}-{count:06d}.warc.zst", "data": bundle(frames), "records": index}], schema=_bundle_schema())
        frames, index, count = [], [], count + 1
        return out

    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            page_id, url, payload, digest, n, refers_to, refers_to_url = (x.as_py() for x in row)
            data = record(page_id, url, None if refers_to is not None else (payload or "").encode(), digest, n, refers_to, refers_to_url, date, f"{date} {part} {written}")
            written += 1
            index.append({"page_id": page_id, "frame": len(frames), "offset": size, "length": len(data)})
            held.append(data)
            size += len(data)
            if size >= frame_bytes:
                close_frame()
                if sum(len(f) for f, _ in frames) >= bundle_bytes:
                    yield close_bundle()
    if held:
        close_frame()
    if frames:
        yield close_bundle()


def _bundle_schema() -> pa.Schema:
    entry = pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    return pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("records", pa.list_(entry))])


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """The records to write: (page_id, url, payload, digest, payload_bytes, refers_to, refers_to_url); refers_to is null for a response.

    Null payload is empty. Of equal payloads of at least min_bytes the smallest page_id is the response, and rows with
    another id or none revisit it; where no row of the group has an id, all are responses. Rows that repeat the
    response's id are responses like it. Empty and short payloads are always responses. An empty table gives no
    records; other columns may have any names. Payloads of a hot group are not brought together.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    counts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("copies"))
    again = staged(counts.where("copies > 1 and first is not null"), "again")
    joined = meet(rows, again, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_url"))


def write_bundles(found: DataFrame, path: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 16 << 20, level: int = 3, date: str | None = None) -> DataFrame:
    """Write the records() as bundles to the Parquet table at path; returns it. Frames hold about frame_bytes raw, bundles about bundle_bytes compressed.

    date is the WARC-Date of all records, in UTC as YYYY-MM-DDThh:mm:ssZ; it is the present time if not given.
    """
    cols = ["page_id", "url", "payload", "digest", "payload_bytes", "refers_to", "refers_to_url"]
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    found.select(cols).mapInArrow(partial(_bundles, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, level=level, date=date), BUNDLE).write.option("compression", "none").parquet(path)
    return found.sparkSession.read.schema(BUNDLE).parquet(path)


def index(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle, frame, offset, length): where each record is, relative to its raw frame."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.page_id", "bundle", "r.frame", "r.offset", "r.length")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for data in batch.column(0):
            view = data.as_py()
            for at, packed, raw in seek_table(view):
                columns = list(zip(*parse(unpacker.decompress(view[at : at + packed], max_output_size=raw)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit)."""
    return bundles.select("data").mapInArrow(_read, RECORD)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for data, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            view, found, frames = data.as_py(), [], {}
            table = seek_table(view)
            for place in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                if place["frame"] not in frames:
                    at, packed, raw = table[place["frame"]]
                    frames = {place["frame"]: unpacker.decompress(view[at : at + packed], max_output_size=raw)}
                found += parse(frames[place["frame"]][place["offset"] : place["offset"] + place["length"]])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)


def fetch(bundles: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the wanted ids; only the frames that hold them are decompressed. Unknown and null ids find nothing."""
    ids = wanted.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id")).distinct()
    places = index(bundles).join(ids, "page_id").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))
    return bundles.select("bundle", "data").join(places, "bundle").select("data", "places").mapInArrow(_fetch, RECORD)
