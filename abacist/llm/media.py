"""Media columns: payloads as PNG images in binary columns, and a perceptual hash of what is read back.

A PNG is built and taken apart here: chunks with their CRC, the zlib stream with its Adler sum, and
the five row filters, undone with numpy.  The hash takes the lowest frequencies of a cosine
transform of the image, shrunk to a square by area.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.common import staged, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payloads are padded with bytes 255 to a positive multiple of UNIT; an image row has WIDTH samples.
UNIT, WIDTH = 576, 24
SIDE, LOW = 32, 8
#: Samples per pixel of the colour types with 8-bit samples.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
COSINES = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(samples: np.ndarray, level: int = 3) -> bytes:
    """An 8-bit greyscale PNG; of the filters none, left and up, the one with the smallest residues."""
    h, w = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    best = min(enumerate((samples, left, up)), key=lambda x: int(np.abs(x[1].view(np.int8).astype(np.int16)).sum()))
    rows = np.empty((h, w + 1), dtype=np.uint8)
    rows[:, 0], rows[:, 1:] = best
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk; a wrong signature, length or checksum raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut off")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(body) < n or len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no end")


def _by_pixel(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Undo the average and Paeth filters, which need each pixel's left neighbour."""
    out, up = [0] * step + row.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], dtype=np.uint8)


def unpng(data: bytes) -> np.ndarray:
    """The samples (height x width x samples per pixel) of a PNG with 8-bit samples, not interlaced."""
    head, packed = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in SAMPLES or any(head[4:]):
        raise ValueError("unsupported PNG")
    w, h, step = head[0], head[1], SAMPLES[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(h, 1 + w * step)
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), h]
    for a, b in zip(cuts, cuts[1:]):
        kind = int(kinds[a])
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, w, step), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                out[y] = _by_pixel(kind, out[y], out[y - 1] if y else np.zeros_like(out[y]), step)
        elif kind:
            raise ValueError("unknown filter")
    return out.reshape(h, w, step)


def _shrink(image: np.ndarray, side: int) -> np.ndarray:
    """Mean by area over ``side`` equal parts of the first axis."""
    total = np.concatenate([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
    edge = np.arange(side + 1) * (len(image) / side)
    low = np.minimum(edge.astype(np.int64), len(image) - 1)
    at = total[low] + (edge - low)[:, None] * image[low]
    return np.diff(at, axis=0) * (side / len(image))


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies lie above their median (the constant one left out)."""
    small = _shrink(_shrink(image.astype(np.float64), SIDE).T, SIDE).T
    f = (COSINES @ small @ COSINES.T).ravel()
    f[0] = 0
    return np.packbits(f > np.median(f[1:])).tobytes()


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a PNG.  Null is empty; an empty text is one unit of padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                media = [png(np.frombuffer(payload(t), dtype=np.uint8).reshape(-1, WIDTH)) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def features(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Sizes, digests and the cosine hash (binary ``hash``, hex ``feature``) of stored media; damaged media raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                image = unpng(data)[:, :, 0]
                raw = image.tobytes()
                h = cosine_hash(image)
                rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), h.hex(), h))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [f.name for f in fields])

    kinds = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "hash": T.BinaryType()}
    fields = [media.schema[id_col], *[T.StructField(k, v) for k, v in kinds.items()]]
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, T.StructType(fields))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = staged(store(table(spark, sf_dir, "documents")), "media", compression="none")
    return features(media).drop("hash")


QUERIES = {"op7_media": op7_media}
ORACLE_SQL: dict[str, str] = {}
