"""WARC records in seekable Zstandard bundles.

A bundle is a whole ``.warc.zst`` archive: records grouped into frames that decompress
on their own, then a skippable frame with the record index, then the seek table of the
seekable format as the footer. A record is found by its frame and its offset inside the
decompressed frame, so reading one record costs one frame. Bundles are rows of a table
(``name``, ``content``, ``records``) that Spark writes and commits: a lost executor
leaves no half archive, and any store that Spark reaches will do.

Records with equal payloads of at least ``min_revisit_bytes`` are written once: the one
with the largest id is the response, the others revisit it.

Edge cases: a null payload is empty; a null URL gives a record without a target; rows
with a null id are records of their own that nothing refers to (responses); repeated
rows of one id each give a record, and none of them revisits its own id: all rows that
hold the largest id of a payload are responses, with one record id, which a bundle's map
resolves to the last of them; an empty table gives no bundle. Only
the three columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.sources.tables import load

from .common import shared_path
from .registry import register

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23

# Fixed values of the seekable Zstandard format
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLE_SCHEMA = (
    "name string, content binary, records array<struct<record_id:string, page_id:bigint, frame:int, offset:int, length:int>>")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> tuple[str, bytes]:
    """Id and bytes of one record. A revisit keeps the HTTP head, whose length is the payload's."""
    rid = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                 ("WARC-Refers-To-Page-ID", str(refers_to))]
    block = http if refers_to is not None else http + payload
    head.append(("Content-Length", str(len(block))))
    return rid, "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the place after the record that begins at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    return head, raw[end + 4 : end + 4 + n], end + 4 + n + 4


class BundleWriter:
    def __init__(self, level: int = 3):
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.records: list[tuple] = []
        self.bytes = 0

    def add(self, rid: str, page_id, record: bytes) -> None:
        self.records.append((rid, page_id, len(self.frames), len(self.open), len(record)))
        self.open += record
        self.bytes += len(record)
        if len(self.open) >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append(self.zstd.compress(bytes(self.open)))
            self.sizes.append((len(self.frames[-1]), len(self.open)))
            self.open = bytearray()

    def finish(self) -> bytes:
        self._close_frame()
        index = zstandard.compress(json.dumps([[r[0], r[2], r[3], r[4]] for r in self.records]).encode())
        table = b"".join(struct.pack("<II", *x) for x in [*self.sizes, (len(index) + 8, 0)])
        table += struct.pack("<IBI", len(self.sizes) + 1, 0, SEEKABLE_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE_INDEX, len(index)), index,
                         struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)), table])


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out, base = 0, [], len(content) - 9 - n * width
    for k in range(n):
        c, d = struct.unpack_from("<II", content, base + k * width)
        out.append((at, c, d))
        at += c
    return out


def record_index(content: bytes) -> dict[str, tuple[int, int, int]]:
    """Record id -> (frame, offset in the frame, length), from the bundle itself."""
    at, size, _ = seek_table(content)[-1]
    return {r: (f, o, n) for r, f, o, n in json.loads(zstandard.decompress(content[at + 8 : at + size]))}


def read_frame(content: bytes, frame: int) -> bytes:
    at, size, plain = seek_table(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[at : at + size], max_output_size=plain)


def read_record(content: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, at the cost of its frame."""
    return parse_record(read_frame(content, frame), offset)[:2]


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the largest id with an equal payload of
    at least ``min_revisit_bytes`` bytes, null for that row itself. Ids and digests are
    grouped before they meet the payloads; the join's large partitions can be split."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha1(F.col("html").cast("binary")))
    last = (rows.where((F.octet_length("html") >= min_revisit_bytes) & F.col("page_id").isNotNull())
            .groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("copies"))
            .where("copies > 1").select("key", "last"))
    return rows.join(last, "key", "left").select(
        "page_id", "url", "html",
        F.when((F.col("last") != F.col("page_id")) & (F.octet_length("html") >= min_revisit_bytes), F.col("last")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of (page_id, url, html) to bundles at ``path``."""

    def work(batches):
        part, count, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def closed():
            raw = writer.finish()
            rows = [dict(zip(("record_id", "page_id", "frame", "offset", "length"), r, strict=True)) for r in writer.records]
            return pa.RecordBatch.from_pylist([{"name": f"pages-{part:06d}-{count:06d}.warc.zst", "content": raw, "records": rows}], _ARROW)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for r in batch.slice(lo, 64).to_pylist():
                    payload = r["html"].encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    writer.add(*(lambda x: (x[0], r["page_id"], x[1]))(
                        build_record(r["page_id"], r["url"], payload, digest, r["refers_to"], date)))
                    if writer.bytes >= BUNDLE_BYTES:
                        yield closed()
                        count, writer = count + 1, BundleWriter()
        if writer.records:
            yield closed()

    with_revisits(pages, min_revisit_bytes).mapInArrow(work, BUNDLE_SCHEMA).write.parquet(path)


_ARROW = pa.schema([
    ("name", pa.string()), ("content", pa.binary()),
    ("records", pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()),
                                    ("offset", pa.int32()), ("length", pa.int32())])))])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, record_id, page_id, frame, offset, length) of every record, without the contents."""
    return spark.read.schema(BUNDLE_SCHEMA).parquet(path).select("name", F.inline("records"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives at ``path``, frame by frame: (name, frame, offset, record_id,
    page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload binary). A
    revisit has no payload."""
    schema = ("name string, frame int, offset int, record_id string, page_id bigint, url string, record_type string, "
              "payload_digest string, payload_bytes bigint, refers_to bigint, payload binary")

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for frame in range(len(seek_table(content)) - 1):
                    raw, at, out = read_frame(content, frame), 0, []
                    while at < len(raw):
                        head, block, after = parse_record(raw, at)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        revisit = head["WARC-Type"] == "revisit"
                        page, to = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                        out.append((name, frame, at, head["WARC-Record-ID"], page and int(page), head.get("WARC-Target-URI"),
                                    head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), size,
                                    to and int(to), None if revisit else payload))
                        at = after
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECORD, strict=True)],
                                                     names=[f"c{k}" for k in range(len(_RECORD))])

    bundles = spark.read.schema(BUNDLE_SCHEMA).parquet(path).select("name", "content")
    return bundles.mapInArrow(work, schema)


_RECORD = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(),
           pa.int64(), pa.binary()]


@register("op1_warc")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_bundles(load(spark, sf_dir, "pages"), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                            "name", "frame", "offset")
