"""WARC bundles in seekable Zstandard: independent frames of records, a seek table as footer, an index to frame offsets."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby
from typing import IO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written
from .files import reading, writing

#: The skippable frame's magic number and the seek table's own, of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the full payload's HTTP header and digest but not the payload."""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target or "urn:none"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    block = HEADER % len(payload) + (b"" if revisit else payload)
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of each record in uncompressed data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield at, stop + 4 - at, fields, data[start:stop]
        at = stop + 4


class BundleWriter:
    """Frames of about ``frame_bytes`` of whole records each, then the seek table."""

    def __init__(self, out: IO[bytes], frame_bytes: int, level: int) -> None:
        import zstandard

        self.out, self.limit = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.at = io.BytesIO(), 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Where the record lies: the frame's offset in the file, then offset and length within the frame."""
        if self.buffer.tell() and self.buffer.tell() + len(data) > self.limit:
            self.flush()
        place = self.at, self.buffer.tell(), len(data)
        self.buffer.write(data)
        return place

    def flush(self) -> None:
        raw = self.buffer.getvalue()
        if raw:
            packed = self.compressor.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw)))
            self.at += len(packed)
            self.buffer = io.BytesIO()

    def places(self) -> Iterator[tuple[int, int]]:
        """Offset and packed size of each frame."""
        at = 0
        for packed, _ in self.frames:
            yield at, packed
            at += packed

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(f: IO[bytes]) -> list[tuple[int, int, int]]:
    """(offset, packed size, raw size) of each frame, from the footer alone."""
    size = f.seek(0, 2) or f.tell()
    f.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no plain seek table at the end")
    f.seek(size - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", f.read(8 * count))
    out, at = [], 0
    for packed, raw in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, raw))
        at += packed
    return out


def read_record(uri: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Random access: one frame is read and unpacked, whatever the bundle's size."""
    import zstandard

    with reading(uri) as f:
        at, packed, raw = next(x for x in seek_table(f) if x[0] == frame)
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=raw)
    _, _, fields, block = next(parse_records(data[offset : offset + length]))
    return fields, block


def plan_revisits(pages: DataFrame, *, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """``pages(page_id, url, payload)`` plus ``refers_to`` and ``revisit``: payloads that several pages share point to the largest id.

    Only digests travel to be counted; repeated digests become a small table of their own, so that a hot one is a skewed
    join which Spark splits, not a group in one task. Equal digests are of equal length here: both are compared.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "bytes": F.length("payload")})
    shared = (
        base.where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top"))
        .where((F.col("n") > 1) & F.col("top").isNotNull())
        .select("digest", "bytes", "top")
    )
    joined = base.join(written(shared, "revisits"), ["digest", "bytes"], "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("top")).alias("refers_to"), F.coalesce(other, F.lit(False)).alias("revisit"))


def write(
    pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, frame_bytes: int = 1 << 20, level: int = 3
) -> DataFrame:
    """Write one bundle per task; returns the index ``(page_id, file, frame, packed, offset, length)``: the frame's offset and size in the file, then the record's place in it.

    Null payload: empty. Null url: a placeholder URI. Null page_id: a record without id. Of records with equal payloads of
    at least ``min_bytes`` that with the largest id is the response; rows that repeat this id are responses too. Very long
    payloads are a frame of their own (below 4 GB). No rows: no bundles, an empty index. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = plan_revisits(pages, id_col=id_col, payload_col=payload_col, min_bytes=min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        index = []
        with writing(folder, name) as out:
            bundle = BundleWriter(out, frame_bytes, level)
            for b in (x for part in ((first,), batches) for x in part):
                for r in range(b.num_rows):
                    page, url, payload, ref, revisit = (b.column(k)[r].as_py() for k in range(5))
                    index.append((page, *bundle.add(record(page, url, payload, ref, revisit))))
            bundle.close()
        size = dict(bundle.places())
        for k in range(0, len(index), 50_000):
            page, frame, offset, length = map(list, zip(*index[k : k + 50_000], strict=True))
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": pa.array(page, pa.int64()), "file": [f"{folder}/{name}"] * len(page), "frame": frame,
                    "packed": [size[f] for f in frame], "offset": offset, "length": length,
                }
            )

    made = rows.mapInArrow(run, "page_id bigint, file string, frame bigint, packed bigint, offset bigint, length bigint")
    return written(made, "warc-index")


def read(index: DataFrame, *, task_frames: int = 64) -> DataFrame:
    """All records of the indexed bundles, read back frame by frame; payload facts of responses are computed from the payload.

    Frames, not files, are dealt out: a task gets about ``task_frames`` of them, fewer where that leaves cores idle.
    """
    spark = index.sparkSession
    frames = index.groupBy("file", "frame", "packed").agg(F.max(F.col("offset") + F.col("length")).alias("raw"))
    n = frames.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // task_frames))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for uri, places in groupby(b.to_pylist(), lambda r: r["file"]):
                with reading(uri) as f:
                    for r in places:
                        f.seek(r["frame"])
                        data = unpack.decompress(f.read(r["packed"]), max_output_size=r["raw"])
                        yield pa.RecordBatch.from_pylist([_facts(fields, block) for _, _, fields, block in parse_records(data)], schema=SCHEMA)

    dealt = frames.repartition(tasks, "file", "frame").sortWithinPartitions("file", "frame")
    return dealt.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _facts(fields: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    said = int(head.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload), payload_digest(payload)) != (said, digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    page, ref = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page), "payload_bytes": said, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": None if ref is None else int(ref),
    }
