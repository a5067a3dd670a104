"""Media columns: documents' bytes as greyscale PNG images, read back with checks, and a perceptual hash.

``encode_png`` writes 8-bit greyscale images (signature, IHDR, IDAT of zlib data, IEND, each chunk with its CRC);
``decode_png`` tests signature, lengths and checksums, inflates, and undoes the five scan-line filters with numpy.
``dct_hash`` keeps the signs of the lowest frequencies of a 32 x 32 reduction's cosine transform, as 8 bytes.
Everything is a per-row map: no shuffle, memory bounded by a text of the batch.

Edge cases: null and empty texts are 64 zero bytes; equal texts give equal values; a damaged image raises
``ValueError``; extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, tidy

WIDTH, LEVEL = 64, 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8
COSINES = np.cos(np.pi * (2 * np.arange(GRID) + 1) * np.arange(LOW)[:, None] / (2 * GRID)).astype(np.float32)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """Scan lines under filter 0 (none), 1 (left) or 2 (above), as unsigned bytes."""
    if kind == 0:
        return image
    out = image.copy()
    if kind == 1:
        out[:, 1:] -= image[:, :-1]
    else:
        out[1:] -= image[:-1]
    return out


def encode_png(image: np.ndarray) -> bytes:
    """A greyscale image (rows x columns of uint8); the filter is the one of 0 to 2 with the least sum of differences."""
    height, width = image.shape
    tries = [filtered(image, k) for k in range(3)]
    kind = int(np.argmin([np.abs(t.view(np.int8).astype(np.int16)).sum() for t in tries]))
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, tries[kind]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, body) of each chunk, after its checksum was tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut short")
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or len(png) < at + 12 + size:
            raise ValueError("a chunk is cut short")
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r} is wrong")
        yield kind, body
        at += 12 + size


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Undo the filters of scan lines whose first byte names them; runs of lines with one filter go together."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    width = out.shape[1]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        kind, above = kinds[a], out[a - 1] if a else np.zeros(width, np.uint8)
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a] += above
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                up, left, corner = out[y - 1].astype(int) if y else np.zeros(width, int), 0, 0
                for x in range(width):
                    if kind == 3:
                        guess = (left + up[x]) // 2
                    else:
                        p = left + up[x] - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                        corner = up[x]
                    left = (int(out[y, x]) + int(guess)) & 255
                    out[y, x] = left
        elif kind:
            raise ValueError(f"filter {kind} is unknown")
    return out


def decode_png(png: bytes) -> np.ndarray:
    parts, head, ended = [], None, False
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG")
    raw = zlib.decompress(b"".join(parts))
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("the image has another size than its header says")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def reduced(image: np.ndarray) -> np.ndarray:
    """GRID x GRID means of the image's cells (nearest lines where it is smaller)."""
    x = image.astype(np.float32)
    for _ in range(2):
        n = len(x)
        if n >= GRID:
            cut = np.arange(GRID + 1) * n // GRID
            x = np.add.reduceat(x, cut[:-1], axis=0) / np.diff(cut)[:, None]
        else:
            x = x[np.arange(GRID) * n // GRID]
        x = x.T
    return x


def dct_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies are above their median (the mean itself left out)."""
    low = (COSINES @ reduced(image) @ COSINES.T).ravel()
    return np.packbits(np.concatenate([[False], low[1:] > np.median(low[1:])])).tobytes()


def media_columns(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the PNG and its hash as binary columns, and the bytes read back from the PNG, of every whole text."""
    schema = docs.select(key).schema
    for name, kind in (("n_bytes", "long"), ("media", "binary"), ("phash", "binary"), ("payload", "binary")):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            out: list[list] = [[], [], []]
            for i in range(len(batch)):
                n = int(offsets[i + 1] - offsets[i])
                image = np.zeros((max(1, -(-n // WIDTH)), WIDTH), np.uint8)
                image.reshape(-1)[:n] = data[offsets[i] : offsets[i + 1]]
                png = encode_png(image)
                back = decode_png(png)
                for column, value in zip(out, (png, dct_hash(back), back.tobytes()), strict=True):
                    column.append(value)
                if (i + 1) % 512 == 0 or i + 1 == len(batch):
                    a = i + 1 - len(out[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, i + 1 - a), pa.array(np.diff(offsets[a : i + 2])), *[pa.array(c, pa.binary()) for c in out]], names=schema.names)
                    out = [[], [], []]

    return docs.select(key, text).mapInArrow(tidy(run), schema)


def op8_media(spark, sf_dir: str) -> DataFrame:
    media = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("phash")).alias("feature"),
    )
