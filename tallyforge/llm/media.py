"""Media columns: 8-bit grey PNG in binary columns, read back with checksum tests, and cosine hashes.

The feature of an image is 64 bits: the 8 x 8 lowest frequencies of a cosine transform of its 32 x 32
reduction, each against their median. All of it is integer arithmetic, so equal images have equal
features on every machine.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import map_texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
PART = 1 << 15  # bytes of a data chunk
LARGEST = (1 << 31) - 1  # bytes of filtered lines of one image: what an Arrow value can hold
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class MediaError(ValueError):
    """The bytes are not a whole, intact PNG of the kind that is stored here."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode_png(payload: bytes) -> bytes:
    """A grey image of 64 columns. The filter is the one of none, left and above that leaves least."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left, above = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    above[1:] -= image[:-1]
    kinds = (image, left, above)
    best = min(range(3), key=lambda k: int(np.abs(kinds[k].view(np.int8).astype(np.int16)).sum()))
    lines = np.empty((len(image), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best]
    data = zlib.compress(lines.tobytes(), 1)
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *[_chunk(b"IDAT", data[k : k + PART]) for k in range(0, len(data), PART)], _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered lines of one byte a sample. Lines of one filter in a row are taken at once
    where the filter allows it."""
    out = np.empty_like(lines)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)]):
        kind, before = kinds[a], out[a - 1] if a else np.zeros(lines.shape[1], np.uint8)
        if kind == NONE:
            out[a:b] = lines[a:b]
        elif kind == SUB:
            np.cumsum(lines[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == UP:
            np.cumsum(lines[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += before
        elif kind in (AVERAGE, PAETH):
            for y in range(a, b):
                up, corner, x = (out[y - 1] if y else np.zeros_like(lines[0])).tolist(), 0, 0
                row = lines[y].tolist()
                for k, u in enumerate(up):
                    if kind == AVERAGE:
                        guess = (x + u) >> 1
                    else:
                        p = x + u - corner
                        guess = min((abs(p - x), 0, x), (abs(p - u), 1, u), (abs(p - corner), 2, corner))[2]
                    x = row[k] = (row[k] + guess) & 255
                    corner = u
                out[y] = row
        else:
            raise MediaError(f"filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG; raises MediaError if a chunk, a checksum or the size is wrong."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise MediaError(f"checksum of {kind!r}")
        at += 12 + size
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise MediaError(f"chunk {kind!r}")
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a whole grey 8-bit image without interlace")
    width, height = head[:2]
    size = height * (width + 1)
    if not width or not height or size > LARGEST:
        raise MediaError("size of the image")
    stream = zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(parts), size + 1)  # no more than the head says, whatever the data hold
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != size or not stream.eof:
        raise MediaError("size of the data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_BINS, _LOW = 32, 8
_COSINES = np.array([[round(4096 * np.cos(np.pi * (2 * x + 1) * u / (2 * _BINS))) for x in range(_BINS)] for u in range(_LOW)], np.int64)


def _reduce(a: np.ndarray) -> np.ndarray:
    """Rows averaged into, or repeated as, 32 rows (in 256ths)."""
    n = len(a)
    starts = np.arange(_BINS) * n // _BINS
    if n < _BINS:
        return a[starts] * 256
    return np.add.reduceat(a, starts, axis=0) * 256 // np.diff(np.append(starts, n))[:, None]


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits of the low frequencies, row by row, as 8 bytes."""
    small = _reduce(_reduce(image.astype(np.int64)).T // 16).T
    low = (_COSINES @ small @ _COSINES.T).ravel()
    return np.packbits(low > np.sort(low)[31]).tobytes()


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each whole text as UTF-8 in a PNG. Null is as empty, which is one
    row of zero samples; a padded text can be told by n_bytes. Rows stay rows, an empty table is empty."""

    def work(slices) -> Iterator[dict]:
        for _, texts in slices:
            raw = [(t or "").encode() for t in texts]
            yield {"n_bytes": [len(r) for r in raw], "media": [encode_png(pad(r)) for r in raw]}

    return map_texts(df, id_col, text_col, "n_bytes long, media binary", work)


def features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with what its media hold when read back: payload_bytes, payload_sha256, tail_crc32 (of the
    last 64 samples), feature binary, error. Unreadable or null media give nulls and the error's text;
    columns of these names are replaced."""
    new = ("payload_bytes", "payload_sha256", "tail_crc32", "feature", "error")
    kept = df.drop(*new)
    at = kept.columns.index(media_col)

    def one(data: bytes | None) -> tuple:
        try:
            image = decode_png(data or b"")
        except MediaError as e:
            return None, None, None, None, str(e)
        payload = image.tobytes()
        return len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), cosine_hash(image), None

    def batches(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
        for batch in rows:
            found = [one(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]], names=[*batch.schema.names, *new])

    added = T.StructType.fromDDL("payload_bytes long, payload_sha256 string, tail_crc32 long, feature binary, error string")
    return kept.mapInArrow(batches, T.StructType([*kept.schema, *added]))


def stored_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `store` writes and `features` reads back, with digests of both forms."""
    read = features(store(df, id_col, text_col))
    return read.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"))
