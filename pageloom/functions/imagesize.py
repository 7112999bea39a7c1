"""Width and height from the header bytes of an image (S9); no pixel is decoded."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

Size = tuple[int, int] | None

SIZE = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())])

# JPEG markers that start a frame, and those without a length.
_FRAMES = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))
_BARE = frozenset((0x01, *range(0xD0, 0xD9)))
#: HEIF boxes that hold other boxes, with the bytes before the first of them.
_CONTAINERS = {b"meta": 4, b"iprp": 0, b"ipco": 0}


def png_size(data: bytes) -> Size:
    return struct.unpack_from(">II", data, 16) if data[12:16] == b"IHDR" else None


def gif_size(data: bytes) -> Size:
    return struct.unpack_from("<HH", data, 6)


def bmp_size(data: bytes) -> Size:
    """Old headers have short sizes; a negative height means rows from the top."""
    if struct.unpack_from("<I", data, 14)[0] == 12:
        return struct.unpack_from("<HH", data, 18)
    width, height = struct.unpack_from("<ii", data, 18)
    return width, abs(height)


def jpeg_size(data: bytes) -> Size:
    """Size in the first frame header; segments before it are skipped by their length."""
    at = 2
    while True:
        if data[at] != 0xFF:
            return None
        while data[at] == 0xFF:  # padding
            at += 1
        marker = data[at]
        at += 1
        if marker in _FRAMES:
            height, width = struct.unpack_from(">HH", data, at + 3)
            return width, height
        if marker in (0xD9, 0xDA):  # the end, or pixels without a frame
            return None
        if marker not in _BARE:
            at += struct.unpack_from(">H", data, at)[0]


def webp_size(data: bytes) -> Size:
    kind = data[12:16]
    if kind == b"VP8X":
        return tuple(int.from_bytes(data[k : k + 3], "little") + 1 for k in (24, 27)) if len(data) >= 30 else None
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = struct.unpack_from("<I", data, 21)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack_from("<HH", data, 26)
        return width & 0x3FFF, height & 0x3FFF
    return None


def _extents(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    while at + 8 <= end:
        size, kind, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8], 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        if kind == b"ispe":
            yield struct.unpack_from(">II", data, at + head + 4)
        elif kind in _CONTAINERS:
            yield from _extents(data, at + head + _CONTAINERS[kind], min(at + size, end))
        at += size


def heic_size(data: bytes) -> Size:
    """The largest image of the file; others are tiles and thumbnails of it."""
    return max(_extents(data, 0, len(data)), key=lambda s: s[0] * s[1], default=None)


def tiff_size(data: bytes) -> Size:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind = struct.unpack_from(order + "HH", data, at + 2 + 12 * k)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)[0]
    return (found[256], found[257]) if len(found) == 2 else None


READERS: dict[str, Callable[[bytes], Size]] = {
    "image/png": png_size,
    "image/gif": gif_size,
    "image/bmp": bmp_size,
    "image/jpeg": jpeg_size,
    "image/webp": webp_size,
    "image/heic": heic_size,
    "image/tiff": tiff_size,
}


def header_size(mime: str | None, data: bytes | None) -> Size:
    """``(width, height)``; None for unknown types, cut or broken headers and empty images."""
    reader = READERS.get(mime or "")
    try:
        size = reader(data) if reader and data else None
    except (struct.error, IndexError):
        return None
    if size is None or not all(0 < side < 2**31 for side in size):
        return None
    return size


@F.arrow_udf(SIZE)
def image_size(mimes: pa.Array, contents: pa.Array) -> pa.Array:
    """Sizes of one Arrow batch; null where the header doesn't tell."""
    sizes = [
        header_size(m, c) for m, c in zip(mimes.to_pylist(), contents.to_pylist())
    ]
    return pa.array(sizes, pa.struct([("w", pa.int32()), ("h", pa.int32())]))
