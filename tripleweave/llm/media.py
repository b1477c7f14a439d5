"""Payloads kept as PNG images in a binary column, read back with all checks, and hashed by their low frequencies."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .base import arrow_bounds, per_text

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a row; the payload is a multiple of it.
WIDTH = 576
PAD = 255


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    n = max(unit, -(-len(raw) // unit) * unit)
    return raw + bytes([PAD]) * (n - len(raw))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 3, part: int = 1 << 16) -> bytes:
    """An 8-bit grey image; a row is filtered by its upper neighbour where that leaves smaller residues."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = lambda x: np.minimum(x, 256 - x.astype(np.int16)).sum(axis=1)
    kinds = np.where(cost(up) < cost(rows), 2, 0).astype(np.uint8)
    kinds[0] = 0
    lines = np.concatenate([kinds[:, None], np.where(kinds[:, None] == 2, up, rows)], axis=1)
    body = zlib.compress(lines.tobytes(), level)
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), *(_chunk(b"IDAT", body[i : i + part]) for i in range(0, len(body), part)), _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the five filters of 8-bit grey rows. Runs of None and Up rows are one cumulative sum."""
    out = np.empty_like(lines)
    height, width = lines.shape
    zero = np.zeros(width, np.uint8)
    i = 0
    while i < height:
        above = out[i - 1] if i else zero
        if kinds[i] == 0:
            j = i
            while j < height and kinds[j] == 0:
                j += 1
            out[i:j] = lines[i:j]
            i = j
            continue
        if kinds[i] == 2:
            j = i
            while j < height and kinds[j] == 2:
                j += 1
            out[i:j] = np.cumsum(np.concatenate([above[None], lines[i:j]]), axis=0, dtype=np.uint8)[1:]
            i = j
            continue
        if kinds[i] == 1:
            out[i] = np.cumsum(lines[i], dtype=np.uint8)
        elif kinds[i] in (3, 4):
            left = corner = 0
            row = [0] * width
            for x, (v, b) in enumerate(zip(lines[i].tolist(), above.tolist(), strict=True)):
                if kinds[i] == 3:
                    guess = (left + b) >> 1
                else:
                    p = left + b - corner
                    near = (abs(p - left), abs(p - b), abs(p - corner))
                    guess = left if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else corner
                left, corner = (v + guess) & 255, b
                row[x] = left
            out[i] = row
        else:
            raise ValueError("unknown filter")
        i += 1
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, not interlaced image. Every chunk's checksum and length and zlib's own sum are
    tested; a fault is a ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", data, at + 8 + n) != (zlib.crc32(kind + body),) if at + 12 + n <= len(data) else True:
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if lines.size != head[1] * (head[0] + 1):
        raise ValueError("rows are missing")
    lines = lines.reshape(head[1], head[0] + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(k), np.arange(n) + 0.5) / n)


_SIDE, _LOW = 32, 8
_BASIS = _cosines(_SIDE, _LOW)


def shrunk(samples: np.ndarray, side: int = _SIDE) -> np.ndarray:
    """Block means on a side x side grid, exact for any height and width; short images repeat their rows."""
    for axis in (0, 1):
        n = samples.shape[axis]
        edges = np.arange(side + 1) * n // side
        if n >= side:
            sums = np.add.reduceat(samples, edges[:-1], axis=axis, dtype=np.float64)
            shape = [1, 1]
            shape[axis] = side
            samples = sums / np.diff(edges).reshape(shape)
        else:
            samples = np.take(samples, edges[:-1], axis=axis)
    return samples.astype(np.float64)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine-transform coefficients, but the mean, exceed their median."""
    low = _BASIS @ shrunk(samples) @ _BASIS.T
    flat = np.round(low.ravel(), 6)
    flat[0] = 0
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def to_png(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as a PNG image in a binary column.

    Null text is empty: one row of padding. A null id, repeated rows and long texts keep their row; an empty table
    gives an empty table; other columns are neither read nor returned. Equal texts give equal images.
    """

    def work(texts: list[bytes]) -> list[list]:
        return [[len(x) for x in texts], [encode_png(padded(x)) for x in texts]]

    return per_text(df, work, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], id_col, text_col)


#: Decoded bytes that a batch of images that are read may hold; an image of more is a batch of its own.
DECODED_BYTES = 8 << 20


def decoded_size(data: bytes | None) -> int:
    """How many samples an image's header promises, without reading them."""
    return 0 if data is None or len(data) < 24 else int(np.prod(struct.unpack_from(">II", data, 16), dtype=np.int64))


def read_png(df: DataFrame, media_col: str = "media", payload_col: str = "payload", hash_col: str = "phash") -> DataFrame:
    """df with the samples read back from its images and their 64-bit hash, both binary. A null or broken image gives
    null in both columns; df must not have columns of these names.

    A header says how large an image is before it is read, so batches are bounded by what images decode to (DECODED_BYTES),
    not by their compressed size, which can be a hundredth of it.
    """
    if clash := {payload_col.lower(), hash_col.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has columns {sorted(clash)}")
    arrow_bounds(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(payload_col, T.BinaryType()), T.StructField(hash_col, T.BinaryType())])
    at = df.columns.index(media_col)

    def read(data: bytes | None) -> tuple[bytes | None, bytes | None]:
        try:
            samples = decode_png(data) if data is not None else None
        except ValueError:
            samples = None
        return (None, None) if samples is None else (samples.tobytes(), cosine_hash(samples))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            media = batch.column(at)
            for n in range(batch.num_rows):
                data = media[n].as_py()
                more = decoded_size(data)
                if held and size + more > DECODED_BYTES:
                    yield made(batch.slice(start, n - start), held)
                    start, held, size = n, [], 0
                held.append(read(data))
                size += more
            yield made(batch.slice(start), held)

    def made(part: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[k] for x in held], pa.binary()) for k in (0, 1))], names=schema.names)

    return df.mapInArrow(run, schema)


def op10_media(spark, sf_dir: str) -> DataFrame:
    stored = read_png(to_png(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2(F.col("payload"), 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.lower(F.hex("phash")).alias("feature"),
    )
