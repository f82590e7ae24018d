"""Operator 1: media columns. Netpbm and BMP to numpy, area resize, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, made_by, quoted, ready, text_of

WIDTH = 64  # samples in a row of a stored payload
TILE = 32  # sides of the NPY tile
_BLOCK = 1 << 14  # rows of the integral image that are held at once

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


# ---------------------------------------------------------------- decoding
def decode_netpbm(data: bytes) -> np.ndarray:
    """P1-P6 to an array (height, width) or (height, width, 3); 8 bits, or 16 where maxval is over 255."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm file")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)):
            raise ValueError("truncated Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if len(head) == 3 else 1
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    count = int(np.prod(shape))
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:]), np.uint8)[:count] - 48
        values = 1 - bits
    elif kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[:count], np.int64)
        values = values.astype(np.uint16 if most > 255 else np.uint8)
    elif kind == b"P4":
        raw = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        values = 1 - np.unpackbits(raw, axis=1)[:, :width]
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, count, at + 1)
        values = values.astype(np.uint16) if most > 255 else values
    if values.size != count:
        raise ValueError("truncated Netpbm samples")
    return (values * np.uint8(255) if kind in (b"P1", b"P4") else values).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette) and 24-bit BMP; a grey identity palette gives (height, width)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    offset, size, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or depth not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP is read")
    rows, stride = abs(height), (width * depth // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if depth == 24:
        return raw[:, : width * 3].reshape(rows, width, 3)[:, :, ::-1]
    colours = (offset - 14 - size) // 4
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    index = raw[:, :width]
    if np.array_equal(palette, np.repeat(np.arange(len(palette), dtype=np.uint8)[:, None], 3, 1)):
        return index
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---------------------------------------------------------------- encoding
def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % image.shape[::-1] + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey BMP, rows bottom up."""
    height, width = image.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = image[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256)[:, None]
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def payload_of(raw: bytes) -> bytes:
    """Padded with 0 to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def store(payload: bytes) -> bytes:
    """The payload as 8-bit samples: BMP where the rows are even in number, else PGM."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(image) if len(image) % 2 else encode_bmp(image)


# ---------------------------------------------------------------- features
def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * (n / parts)
    low = np.minimum(np.floor(at).astype(np.int64), n)
    return low, at - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output cell's exact area, from the integral image.

    The integral image is made in blocks of rows and only the rows at cell edges are
    kept, so memory doesn't grow with the height.
    """
    grey = image.mean(axis=2) if image.ndim == 3 else image
    rows, cols = grey.shape
    low, part = _edges(rows, height)
    need = np.unique(np.concatenate((low, np.minimum(low + 1, rows))))
    kept, carry = np.zeros((len(need), cols + 1)), np.zeros(cols + 1)
    for at in range(0, rows, _BLOCK):
        block = np.zeros((min(_BLOCK, rows - at) + 1, cols + 1))
        block[0] = carry
        np.cumsum(grey[at : at + _BLOCK], axis=1, out=block[1:, 1:])
        np.cumsum(block, axis=0, out=block)
        inside = (need > at) & (need < at + len(block))
        kept[inside] = block[need[inside] - at]
        carry = block[-1]
    upper = kept[np.searchsorted(need, np.minimum(low + 1, rows))]
    lower = kept[np.searchsorted(need, low)]
    lines = lower + (upper - lower) * part[:, None]
    low, part = _edges(cols, width)
    right = lines[:, np.minimum(low + 1, cols)]
    grid = lines[:, low] + (right - lines[:, low]) * part
    return np.diff(np.diff(grid, axis=0), axis=1) * (height * width / (rows * cols))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 reduction is brighter than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side 8-bit samples, as the bytes of an NPY file."""
    tile = np.clip(np.floor(area_resize(image, side, side) + 0.5 + 1e-9), 0, 255).astype(np.uint8)
    np.save(out := io.BytesIO(), np.ascontiguousarray(tile), allow_pickle=False)  # rows first, whatever the resize left
    return out.getvalue()


# ---------------------------------------------------------------- operator
FEATURES = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "shape": "string", "tile": "binary", "error": "string"}


def describe(data: bytes | None, side: int = TILE) -> tuple:
    """FEATURES of one stored image; without media all are null, of unreadable bytes all but their size, digest and the error."""
    if data is None:
        return (None,) * len(FEATURES)
    stored = (len(data), hashlib.sha256(data).hexdigest())
    try:
        image = decode(data)
        if not image.size:
            raise ValueError("an image without samples")
        payload = image.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, difference_hash(image), f"{image.shape[1]}x{image.shape[0]}", npy_tile(image, side), None)
    except (ValueError, struct.error, OverflowError) as e:
        return (None, None, None, *stored, None, None, None, str(e) or type(e).__name__)


def _described(stored) -> list[tuple]:
    return list(zip(*(describe(d) for d in stored), strict=True))


def text_media(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Every whole text as an image: id, n_bytes, media (BMP or PGM bytes), for writing. Null and empty texts: one row of zeros."""
    ready(docs.sparkSession)

    def encode(texts: list[str]) -> tuple[list]:
        return ([store(payload_of(t.encode("utf-8", "surrogatepass"))) for t in texts],)

    t = text_of(docs, text)
    return docs.select(docs[quoted(id)].alias("id"), F.octet_length(t).cast("long").alias("n_bytes"), made_by(lambda: encode, {"media": "binary"}, t)["media"].alias("media")).withColumnRenamed("id", id)


def media_features(media: DataFrame, name: str = "media") -> DataFrame:
    """Decode each image in the column ``name``, whatever its format, and describe it.

    Replaces the column by FEATURES: digests of the samples read back and of the stored form,
    the difference hash (hexadecimal), the shape and the NPY tile. Unreadable bytes give null
    features and say why in ``error``; null media gives nulls only. Other columns pass, but
    for those called as a feature, which are replaced.
    """
    ready(media.sparkSession)
    (own,) = fresh(media, "made")
    taken = {name.lower(), *FEATURES}
    made = media.select(*(media[quoted(c)] for c in media.columns if c.lower() not in taken), made_by(lambda: _described, FEATURES, media[quoted(name)]).alias(own))
    return made.select(*(F.col(quoted(c)) for c in made.columns if c != own), *(F.col(own)[k].alias(k) for k in FEATURES))


def media_columns(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Store and read back every text; id, n_bytes, digests of both forms, feature, NPY tile.

    Texts are stored and the stored bytes read back in one pass, a batch of bounded bytes at a
    time: images don't travel. Null or empty text: n_bytes 0, one row of 64 zero samples. Null
    ids and repeated rows give a row each, an empty table none; a very long text is one tall
    image, whose integral image is made in blocks. Other columns aren't read. No shuffle.
    """
    ready(docs.sparkSession)

    def run(texts: list[str]) -> list[tuple]:
        return _described(store(payload_of(t.encode("utf-8", "surrogatepass"))) for t in texts)

    t = text_of(docs, text)
    made = docs.select(docs[quoted(id)].alias("id"), F.octet_length(t).cast("long").alias("n_bytes"), made_by(lambda: run, FEATURES, t).alias("made"))
    return made.select(F.col("id").alias(id), "n_bytes", *(F.col("made")[k].alias(k) for k in FEATURES))
