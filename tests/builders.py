"""Rows as tuples, small image files of every format, and rows of the images table."""

from __future__ import annotations

import struct
import zlib


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def png(width: int, height: int, extra: bytes = b"") -> bytes:
    body = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    chunk = struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body))
    return b"\x89PNG\r\n\x1a\n" + chunk + extra


def gif(width: int, height: int) -> bytes:
    return b"GIF89a" + struct.pack("<HH", width, height) + b"\x00\x00\x00;"


def bmp(width: int, height: int) -> bytes:
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, 0, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + info


def bmp_os2(width: int, height: int) -> bytes:
    return b"BM" + struct.pack("<IHHI", 26, 0, 0, 26) + struct.pack("<IHHHH", 12, width, height, 1, 24)


def jpeg(width: int, height: int, app_bytes: int = 14) -> bytes:
    app = b"\xff\xe0" + struct.pack(">H", app_bytes + 2) + bytes(app_bytes)
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + app + b"\xff" + frame + b"\xff\xd9"


def webp(kind: bytes, width: int, height: int) -> bytes:
    if kind == b"VP8 ":
        body = b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", width | 0x4000, height)
    elif kind == b"VP8L":
        body = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14) + bytes(8)
    else:
        body = bytes(4) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def tiff(width: int, height: int, order: str = "<") -> bytes:
    mark = b"II" if order == "<" else b"MM"
    first = struct.pack(order + "HHII", 256, 4, 1, width)
    second = struct.pack(order + "HHIHH", 257, 3, 1, height, 0)
    head = mark + struct.pack(order + "HI", 42, 16) + bytes(8)
    return head + struct.pack(order + "H", 2) + first + second + bytes(4)


def image_row(name: str, digit: str, width: int = 640, height: int = 360):
    return (f"shelf/{name}", width, height, "webp", digit * 64, 70001)


IMAGE_COLUMNS = (
    "file_location string, width int, height int, file_type string, hash string, file_size bigint"
)
