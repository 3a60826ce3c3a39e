"""WARC records in seekable Zstandard bundles.

Pages are dealt evenly over tasks by a hash of page_id. Each task appends records to independent frames of about
``frame_bytes``, and closes a bundle at about ``bundle_bytes`` with a footer seek table (the public seekable
format: a skippable frame with each frame's compressed and decompressed size). A bundle is a row (bundle_id,
data, entries) whose entries map record identifiers to (frame, offset in the frame, length). Bundles are written
as a Parquet table in the cluster's shared folder, so any executor can read them through Spark's own readers.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is the response and
the others are revisits that refer to it. The largest page_id per digest is found by a groupBy with map-side
combine and joined back on slim rows, so one payload on a third of all pages moves no text twice.

A null payload is empty. Rows that repeat the largest page_id are all responses. A null page_id is a
record of its own and counts as the smallest. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import shared_folder, slices, table

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """One WARC 1.1 record; a revisit keeps the digest and length but not the payload."""
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    body = payload if kind == "response" else b""
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Header fields in lower case, and ``payload``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields | {"payload": rest[: int(fields["content-length"])]}


class BundleWriter:
    """Frames, their seek table, and where each record lies."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.sizes, self.entries, self.open, self.length, self.done = [], [], [], [], 0, 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.entries.append({"page_id": page_id, "frame": len(self.frames), "offset": self.length, "length": len(data)})
        self.open.append(data)
        self.length += len(data)
        if self.length >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.length))
            self.done += len(frame)
            self.open, self.length = [], 0

    def finish(self) -> bytes:
        self.flush()
        seek = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(seek)) + seek


class BundleReader:
    """Opens frames on demand by the seek table at the end."""

    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        at, starts = len(data) - 9 - width * count, [0]
        for i in range(count):
            starts.append(starts[-1] + struct.unpack_from("<I", data, at + width * i)[0])
        self.data, self.starts, self.at, self.frame = memoryview(data), starts, -1, b""

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.at:
            self.frame = zstandard.ZstdDecompressor().decompress(self.data[self.starts[frame] : self.starts[frame + 1]])
            self.at = frame
        return self.frame[offset : offset + length]


ENTRY = "struct<page_id:long,frame:int,offset:long,length:long>"


def with_record_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the response's page_id for revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where((F.col("n") >= least) & F.col("page_id").isNotNull())
    slim = slim.select("page_id", F.unhex("digest").alias("digest"))
    # Only payloads that occur with more than one page_id matter from here on.
    first = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low")
    revisits = slim.join(first, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    told = rows.withColumn("digest", F.unhex(F.sha1("html"))).join(revisits, ["page_id", "digest"], "left")
    return told.select("page_id", "url", "html", "refers_to")


def write_bundles(typed: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle_id, data, entries); ``typed`` has the columns of with_record_types."""

    def run(batches):
        base, made, writer = TaskContext.get().partitionId() << 32, 0, BundleWriter(frame_bytes)

        def close():
            data = writer.finish()
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made], pa.int64()), pa.array([data], pa.binary()), pa.array([writer.entries], pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))],
                ["bundle_id", "data", "entries"],
            )

        for batch in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(page_id, record("response" if refers_to is None else "revisit", page_id, url, html.encode(), refers_to))
                if writer.done >= bundle_bytes:
                    yield close()
                    made, writer = made + 1, BundleWriter(frame_bytes)
        if writer.entries:
            yield close()

    return typed.select("page_id", "url", "html", "refers_to").mapInArrow(run, f"bundle_id long, data binary, entries array<{ENTRY}>")


def read_records(bundles: DataFrame) -> DataFrame:
    """Every record, fetched by its entry: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        for batch in batches:
            for data, entries in zip(batch.column("data").to_pylist(), batch.column("entries").to_pylist()):
                reader = BundleReader(data)
                for i in range(0, len(entries), 256):
                    rows = []
                    for e in entries[i : i + 256]:
                        got = parse(reader.read(e["frame"], e["offset"], e["length"]))
                        to = got.get("warc-refers-to")
                        rows.append((e["page_id"], got["warc-target-uri"], got["payload"], int(got["x-payload-length"]), got["warc-payload-digest"].removeprefix("sha1:"), got["warc-type"], int(to[10:-1]) if to else None))
                    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    return bundles.mapInArrow(run, schema)


def archive(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Writes the pages' bundles to a Parquet table at ``path`` and gives the table read back."""
    write_bundles(with_record_types(pages, least)).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return read_records(archive(pages, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top, list_aggregate(list_transform(range(1, 41),
      lambda i: lpad(bin(('0x' || substr(h, i, 1))::INT), 4, '0')), 'string_agg', '') AS bits
  FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (substr(bits, i * 5 + 1, 1)::INT * 16 + substr(bits, i * 5 + 2, 1)::INT * 8 + substr(bits, i * 5 + 3, 1)::INT * 4
     + substr(bits, i * 5 + 4, 1)::INT * 2 + substr(bits, i * 5 + 5, 1)::INT + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM b
"""
