"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a footer (a skippable
frame in the public seekable format) lists the frame sizes, so a reader finds
one record by its frame and its offset inside the frame.  Bundles are rows
of a table in shared storage (``content`` is a complete ``.warc.zst`` file);
``export`` writes them out as files.

Payloads of at least ``min_revisit`` bytes that are equal are stored once: the
record with the largest page id is the response, the others revisit it.

Defined results: a null payload is empty; a null URL has no target header; a
null page id sorts below all others and has an empty record name; rows that
share both the largest page id and the payload are all responses; an empty
table gives no bundle and an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm._store import SMALL_GROUPS, bounded, materialise

MIN_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Fixed values of the seekable format: magic numbers of the footer's frame and of its end.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_NAME = "urn:hearth:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to.

    Only digests travel to find equal payloads, summed before the shuffle; a
    payload shared by a third of all pages is one row there.  Payloads are
    joined in place where the table of repeated digests is small.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    key = F.sha2("payload", 256)
    repeated = materialise(
        rows.filter(F.length("payload") >= min_revisit).groupBy(key.alias("_key"))
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "payloads")
    rows = rows.join(bounded(repeated, 128), key == F.col("_key"), "left")
    again = F.col("_key").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.select("page_id", "url", "payload", F.sha1("payload").alias("payload_digest"),
                       F.when(again, "revisit").otherwise("response").alias("record_type"),
                       F.when(again, F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None,
           date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_NAME}{'' if page_id is None else page_id}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at: body - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    end = body + int(headers["Content-Length"])
    if data[end: end + 4] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, data[body:end], end + 4


class BundleWriter:
    """Builds one bundle; ``index`` has (record name, frame, offset in the frame, length)."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self._zstd, self._most = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self._open: list[bytes] = []
        self._size = 0
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.frames), self._size, len(data)))
        self._open.append(data)
        self._size += len(data)
        if self._size >= self._most:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._open:
            self.frames.append(self._zstd.compress(b"".join(self._open)))
            self.sizes.append((len(self.frames[-1]), self._size))
            self._open, self._size = [], 0

    @property
    def packed_bytes(self) -> int:
        return sum(x for x, _ in self.sizes)

    def content(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table])


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, size) of every frame, read from the footer."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    table = content[-9 - 8 * count: -9]
    if struct.unpack("<II", content[-17 - 8 * count: -9 - 8 * count]) != (SKIPPABLE_MAGIC, 8 * count + 9):
        raise ValueError("the seek table is damaged")
    out, at = [], 0
    for k in range(count):
        packed, size = struct.unpack_from("<II", table, 8 * k)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(content: bytes, frame: int) -> bytes:
    start, packed, size = seek_table(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[start: start + packed], max_output_size=size)


def read_record(content: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Random access: unpacks one frame only."""
    return parse(read_frame(content, frame), offset)[:2]


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles: bundle, content, and ``index`` (record, frame, offset, length)."""
    rows = with_record_types(pages, id_col, url_col, payload_col, min_revisit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def out() -> pa.RecordBatch:
            index = [dict(zip(("record", "frame", "offset", "length"), x, strict=True)) for x in writer.index]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"part-{part:06d}-{number:06d}.warc.zst"]), pa.array([writer.content()], pa.binary()),
                 pa.array([index], pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))],
                names=["bundle", "content", "index"])

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(6)), strict=True):
                page_id, url, payload, digest, kind, refers_to = (x.as_py() for x in row)
                writer.add(f"{_NAME}{'' if page_id is None else page_id}", record(page_id, url, payload, digest, kind, refers_to))
                if writer.packed_bytes >= bundle_bytes:
                    yield out()
                    number, writer = number + 1, BundleWriter(frame_bytes)
        if writer.index:
            yield out()

    bundles = rows.mapInArrow(run, "bundle string, content binary, index array<struct<record:string,frame:int,offset:bigint,length:bigint>>")
    return materialise(bundles, "warc", SMALL_GROUPS)


def record_index(bundles: DataFrame) -> DataFrame:
    """One row per record: where it lies."""
    return bundles.select("bundle", F.inline("index"))


def export(bundles: DataFrame, folder: str) -> int:
    """Write each bundle as a file into a folder that every executor mounts; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("bundle").to_pylist()
            for name, content in zip(names, batch.column("content"), strict=True):
                with open(os.path.join(folder, f".{name}.tmp"), "wb") as f:
                    f.write(content.as_py())
                os.replace(f.name, os.path.join(folder, name))  # a repeated task writes the same file
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["bundle"])

    return bundles.select("bundle", "content").mapInArrow(run, "bundle string").count()


def read_back(bundles: DataFrame) -> DataFrame:
    """One row per record, from the bundles' bytes alone; digests of stored payloads are checked."""

    def rows_of(content: bytes) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()
        for start, packed, size in seek_table(content):
            data, at = unpack.decompress(content[start: start + packed], max_output_size=size), 0
            while at < len(data):
                headers, block, at = parse(data, at)
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(http.rpartition(b"Content-Length: ")[2])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                names = [headers.get(k, "")[len(_NAME) + 1: -1] for k in ("WARC-Record-ID", "WARC-Refers-To")]
                yield int(names[0]) if names[0] else None, length, digest, headers["WARC-Type"], int(names[1]) if names[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for content in batch.column("content"):
                columns = list(zip(*rows_of(content.as_py()), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("content").mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
