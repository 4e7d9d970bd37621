"""Media columns: PNG written and read with numpy and zlib, and low-frequency cosine-transform hashes.

A text's bytes become an 8-bit grey image, WIDTH samples a row; the image is stored as PNG in a binary
column.  Reading checks the signature, every chunk's length and checksum, and the sizes, inflates the
data and undoes the row filters with numpy.  All work is per row, so Spark's partitions bound memory.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 576
PAD = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1
#: Side of the image that is transformed, and of the low-frequency square kept.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filter_rows(image: np.ndarray) -> np.ndarray:
    """PNG rows of a grey image: for each row the first of none, Sub and Up with the smallest sum of
    absolute (signed) values, its number before it."""
    h, w = image.shape
    sub = image.copy()
    sub[:, 1:] -= image[:, :-1]
    up = image.copy()
    up[1:] -= image[:-1]
    kinds = np.stack([image, sub, up])
    cost = np.minimum(kinds, -kinds).astype(np.int32).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((h, w + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(h)]
    return out


def unfilter_rows(rows: np.ndarray) -> np.ndarray:
    """The grey image of PNG rows with any of the five filters (one byte per sample).  Runs of rows
    without a filter or with Up, and each Sub row, are one numpy operation; Average and Paeth go by sample."""
    kinds, data = rows[:, 0], rows[:, 1:]
    h, w = data.shape
    out = np.empty((h, w), np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, h]):
        kind = kinds[a] if h else 0
        above = out[a - 1] if a else np.zeros(w, np.uint8)
        if kind == 0:
            out[a:b] = data[a:b]
        elif kind == 1:
            np.cumsum(data[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(data[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            for i in range(a, b):
                above = out[i - 1] if i else np.zeros(w, np.uint8)
                left = corner = 0
                for x in range(w):
                    top = int(above[x])
                    if kind == 3:
                        guess = (left + top) // 2
                    else:
                        p = left + top - corner
                        near = (abs(p - left), abs(p - top), abs(p - corner))
                        guess = (left, top, corner)[near.index(min(near))]
                    left = out[i, x] = (int(data[i, x]) + guess) & 255
                    left, corner = int(left), top
        else:
            raise ValueError(f"row filter {kind}")
    return out


def write_png(samples: bytes, width: int = WIDTH) -> bytes:
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    data = zlib.compress(filter_rows(image).tobytes(), LEVEL)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def read_png(stored: bytes) -> np.ndarray:
    """The grey image of a PNG; ValueError if it is damaged or of another kind."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(stored):
        if at + 12 > len(stored):
            raise ValueError("cut off")
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(stored):
            raise ValueError("cut off")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown chunk {kind!r}")
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    width, height = head[:2]
    if len(rows) != height * (width + 1):
        raise ValueError("wrong size")
    return unfilter_rows(rows.reshape(height, width + 1))


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


_COS = _cosines()


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: which of the 8 x 8 lowest frequencies of the image, averaged to 32 x 32,
    exceed the median of all but the constant one."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    r0, c0 = np.arange(SIDE) * h // SIDE, np.arange(SIDE) * w // SIDE
    r1, c1 = np.maximum((np.arange(SIDE) + 1) * h // SIDE, r0 + 1), np.maximum((np.arange(SIDE) + 1) * w // SIDE, c0 + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    small = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / area
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as UTF-8, padded with bytes 255 to a positive multiple of
    576, stored as PNG.  A null text counts as empty (one row of padding).  Repeated rows give equal
    rows; other columns do not enter."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sizes, stored = [], []
                for value in part.column(1).cast(pa.binary()):
                    data = value.as_py() or b""
                    sizes.append(len(data))
                    stored.append(write_png(data + bytes([PAD]) * ((-len(data)) % WIDTH if data else WIDTH)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], names=["doc_id", "n_bytes", "media"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, feature): the samples read back from media, and their hash."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                payloads, features = [], []
                for value in part.column(2):
                    image = read_png(value.as_py())
                    payloads.append(image.tobytes())
                    features.append(cosine_hash(image))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    id_type = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary, payload binary, feature string")


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document stored as an image and read back; a null text counts as empty, repeated texts give equal values."""
    from .common import read

    m = read_media(store_media(read(spark, sf_dir, "documents")))
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
