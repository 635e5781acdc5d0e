"""Media columns: bytes stored as lossless WebP images, and images read into pixel arrays.

A payload of 8-bit samples becomes one or more grey images of `WIDTH` columns (tiles of at most `TILE`
samples, so memory is bounded however long a payload is), concatenated RIFF containers in one binary column.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm import webp
from palimpsest.llm.common import emit, pick, slices, texts

WIDTH = 64
TILE = WIDTH * 2048


def padded(text: bytes, multiple: int = WIDTH) -> bytes:
    """Bytes 0 appended up to a positive multiple."""
    return text + bytes(-len(text) % multiple or (0 if text else multiple))


def store(payload: bytes) -> bytes:
    """Samples (a positive multiple of WIDTH) as concatenated lossless WebP tiles."""
    return b"".join(webp.encode_samples(payload[i : i + TILE], WIDTH) for i in range(0, len(payload), TILE))


def frames(media: bytes) -> Iterator[np.ndarray]:
    """The pixels (height, width) of each concatenated RIFF container."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield webp.decode(media[at : at + size])
        at += size


def read(media: bytes) -> bytes:
    """The samples that `store` was given."""
    return b"".join(((f >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() for f in frames(media))


def features(samples: bytes) -> str:
    """Size, mean, variance, row-to-row change and an 8-bin histogram (per mille), in whole numbers."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    n, levels = len(a), np.arange(256)
    mean = int((counts * levels).sum()) // n
    var = int((counts * levels**2).sum()) // n - mean**2
    change = int(np.abs(np.diff(a.astype(np.int16))).sum()) // n
    bins = counts.reshape(8, 32).sum(axis=1) * 1000 // n
    return f"{WIDTH}x{n // WIDTH} mean={mean} var={var} change={change} hist={','.join(map(str, bins.tolist()))}"


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a media column; null text: empty.

    One row per input row, repeated and null ids included.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in slices(batches):
            own = [t or b"" for t in b.column(1).to_pylist()]
            yield emit(schema, {"doc_id": b.column(0).cast(pa.int64()), "n_bytes": [len(t) for t in own], "media": [store(padded(t)) for t in own]})

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pixels(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, frame int, width int, height int, argb binary): one row per image of a media column.

    argb: little-endian uint32 pixels, row by row. A null or empty medium has no frames. Bytes that are no
    lossless WebP fail the job with CorruptImage rather than yield wrong pixels.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())])

    def run(batches):
        for b in slices(batches, "media", most_bytes=1 << 20):
            for doc, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, f in enumerate(frames(media or b"")):
                    yield emit(schema, {"doc_id": [doc], "frame": [k], "width": [f.shape[1]], "height": [f.shape[0]], "argb": [f.astype("<u4").tobytes()]})

    return pick(df, doc_id=id_col, media=media_col).mapInArrow(run, "doc_id long, frame int, width int, height int, argb binary")


def described(df: DataFrame) -> DataFrame:
    """to_media's rows with what reading the stored bytes back shows: digests of both forms and features."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split(" ") for x in fields.split(", "))])

    def run(batches):
        for b in slices(batches, "media"):
            media = b.column(2).to_pylist()
            back = [read(m) for m in media]
            yield emit(schema, {
                "doc_id": b.column(0), "n_bytes": b.column(1), "payload_bytes": [len(p) for p in back], "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back], "tail_crc32": [zlib.crc32(p[-64:]) for p in back],
                "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": [features(p) for p in back],
            })

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, fields)
