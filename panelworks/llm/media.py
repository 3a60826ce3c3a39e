"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, written as NPY tiles with difference hashes.

``media_features`` takes a binary column of files (Netpbm P1 to P6, uncompressed BMP of 1, 4, 8, 24 or 32
bits) and gives, per file, its size, an area-resized NPY tile and a 64-bit difference hash. A null, empty or
undecodable file has null features and an ``error`` text. Equal files give equal rows; extra columns are kept.

Area resize is exact: an integral image is interpolated at the fractional cell edges, so each output cell is
the mean over its area, for any size, in time linear in the pixels.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import slices, stored, table, texts

TILE = 24


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples; 8 bits wide up to a maximum of 255, else 16."""
    kind = data[:2]
    wanted, at, head = 2 if kind in (b"P1", b"P4") else 3, 2, []
    while len(head) < wanted:
        found = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not found:
            raise ValueError("Netpbm header")
        head.append(int(found[1]))
        at = found.end()
    width, height, top = head[0], head[1], head[2] if wanted == 3 else 1
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    count = int(np.prod(shape))
    if kind == b"P1":
        bits = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:count]
        if bits.strip(b"01"):
            raise ValueError("Netpbm bits")
        return (1 - (np.frombuffer(bits, np.uint8) - 48)).reshape(shape) * np.uint8(255)
    if kind in (b"P2", b"P3"):
        return np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:count], np.uint16 if top > 255 else np.uint8).reshape(shape)
    at += 1  # one white space ends the header
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        kind_of = np.dtype(">u2") if top > 255 else np.dtype("u1")
        return np.frombuffer(data, kind_of, count, at).reshape(shape)
    raise ValueError("not Netpbm")


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3) RGB, or (height, width) when every palette entry is grey."""
    start, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if header < 40 or packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("BMP kind")
    if packing == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("BMP masks")  # samples in another order
    rows, stride = abs(height), -(-width * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if bits >= 24:
        return raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)[:, 2::-1]
    if bits == 8:
        index = raw[:, :width]
    else:
        step = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        index = step.dot(1 << np.arange(bits - 1, -1, -1))[:, :width]
    colours = palette[index]
    return colours[:, :, 0] if (palette == palette[:, :1]).all() else colours


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def resize_area(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each output cell's area; grey values as float64."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    for size in (height, width):  # one axis, then the other, each by differences of a running sum
        total = np.zeros((grey.shape[0] + 1, grey.shape[1]))
        np.cumsum(grey, axis=0, dtype=np.float64, out=total[1:])
        edges = np.linspace(0, grey.shape[0], size + 1)
        low = np.minimum(edges.astype(np.int64), grey.shape[0] - 1)
        part = (edges - low)[:, None]
        at = total[low] * (1 - part) + total[low + 1] * part
        grey = (np.diff(at, axis=0) * (size / grey.shape[0])).T
    return grey


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means is darker than its right neighbour."""
    cells = np.round(resize_area(pixels, 8, 9), 6)
    return int.from_bytes(np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes(), "big")


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    tile = np.clip(np.rint(resize_area(pixels, side, side)), 0, 65535).astype(np.uint16 if pixels.dtype.itemsize > 1 else np.uint8)
    np.save(out := io.BytesIO(), tile, allow_pickle=False)
    return out.getvalue()


def media_features(files: DataFrame, column: str = "media", side: int = TILE) -> DataFrame:
    """Adds media_height, media_width, media_channels, tile (NPY bytes), dhash (16 hex digits) and error; these names are replaced."""
    added = "media_height int, media_width int, media_channels int, tile binary, dhash string, error string"
    names = [x.split()[0] for x in added.split(", ")]
    kept = files.drop(*names)

    def run(batches):
        for batch in slices(batches, column):
            rows = []
            for data in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    pixels = decode(data or b"")
                    if not pixels.size:
                        raise ValueError("no pixels")
                    rows.append((*pixels.shape[:2], pixels.shape[2] if pixels.ndim == 3 else 1, npy_tile(pixels, side), f"{difference_hash(pixels):016x}", None))
                except (ValueError, IndexError, struct.error, OverflowError) as e:
                    rows.append((None, None, None, None, None, str(e)[:80] or "undecodable"))
            kinds = [pa.int32()] * 3 + [pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), added])
    return kept.mapInArrow(run, schema)


def text_media(docs: DataFrame, width: int = TILE, unit: int = TILE * TILE) -> DataFrame:
    """Each text's bytes, filled with 255 up to a positive multiple of ``unit``, as a grey PGM file of that width."""

    def run(batches):
        for batch in slices(batches, "text"):
            raw = [t.encode() for t in texts(batch)]
            media = []
            for t in raw:
                padded = t + b"\xff" * (-len(t) % unit if t else unit)
                media.append(encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def payload_digests(files: DataFrame, unit: int = TILE * TILE) -> DataFrame:
    """Reads the stored files back and digests their samples: (payload_bytes, payload_sha256, tail_crc32)."""
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long"

    def run(batches):
        for batch in slices(batches, "media"):
            rows = []
            for data in batch.column(batch.schema.get_field_index("media")).to_pylist():
                payload = decode(data).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.int64()]))], [*batch.schema.names, *(x.split()[0] for x in added.split(", "))])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields), added])
    return files.mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = payload_digests(media_features(stored(text_media(table(spark, sf_dir, "documents")), "media")))
    return files.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature"),
    )
