"""Width and height from an image header.

For bytes in a table all formats are column expressions; for JPEG and TIFF these follow the chain of
segments step by step. Tasks that read files themselves follow the chain in Python as they read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Size = tuple[int, int]

# Leading bytes of each format; WebP names its variant at byte 8.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PNG_FIRST_CHUNK = b"IHDR"
GIF_MAGICS = (b"GIF87a", b"GIF89a")
BMP_MAGIC = b"BM"
RIFF_MAGIC = b"RIFF"
WEBP_LOSSY = b"WEBPVP8 "
WEBP_LOSSLESS = b"WEBPVP8L"
WEBP_EXTENDED = b"WEBPVP8X"
JPEG_MAGIC = b"\xff\xd8\xff"
TIFF_MAGICS = (b"II*\x00", b"MM\x00*")

# Bytes that hold the size in all formats without a chain; size of the OS/2 bitmap
# header; bits of a WebP side.
HEADER_BYTES = 32
BMP_OS2_HEADER = 12
WEBP_SIDE_BITS = 14

# The JPEG frame headers (which carry the size) and the markers without a body.
JPEG_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
JPEG_BARE = frozenset(range(0xD0, 0xD9)) | {0x01}
# TIFF field numbers for width and length, and the two integer field types.
TIFF_WIDTH, TIFF_LENGTH = 256, 257
TIFF_SHORT, TIFF_LONG = 3, 4


# Bytes of a JPEG or TIFF file that are looked at first; more follow if they do not tell.
CHAIN_PREFIX = 64 * 1024
# Steps of a JPEG chain that are taken at once; the root of more steps than a value has bytes, for the few
# chains that go on after those.
FIRST_STEPS, MORE_STEPS = 24, 1300


class CutShort(Exception):
    """The bytes end before the size is told."""


def jpeg_size(data: bytes) -> Size | None:
    """Follow the marker segments to the first frame header."""
    pos = 2
    while data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker in JPEG_FRAMES:
            height, width = struct.unpack_from(">HH", data, pos + 5)
            return width, height
        if marker == 0xFF:  # fill byte
            pos += 1
        elif marker in JPEG_BARE:
            pos += 2
        else:
            pos += 2 + struct.unpack_from(">H", data, pos + 2)[0]
    return None


def tiff_size(data: bytes) -> Size | None:
    """Read width and length from the first image directory."""
    order = "<" if data[:2] == b"II" else ">"
    (start,) = struct.unpack_from(order + "I", data, 4)
    (fields,) = struct.unpack_from(order + "H", data, start)
    found: dict[int, int] = {}
    for entry in range(start + 2, start + 2 + 12 * fields, 12):
        number, kind = struct.unpack_from(order + "HH", data, entry)
        if number in (TIFF_WIDTH, TIFF_LENGTH) and kind in (TIFF_SHORT, TIFF_LONG):
            code = "H" if kind == TIFF_SHORT else "I"
            (found[number],) = struct.unpack_from(order + code, data, entry + 8)
    return (found[TIFF_WIDTH], found[TIFF_LENGTH]) if len(found) == 2 else None


def chained_size(data: bytes) -> Size | None:
    """Size of a JPEG or TIFF, None for anything else; CutShort if more bytes could tell."""
    if not data.startswith((JPEG_MAGIC, *TIFF_MAGICS)):
        return None
    reader = jpeg_size if data.startswith(JPEG_MAGIC) else tiff_size
    try:
        return reader(data)
    except (struct.error, IndexError) as error:
        raise CutShort from error


def starts_with(content: Column, magic: bytes) -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))


def _unsigned(content: Column, start: int, size: int, little: bool) -> Column:
    """An unsigned number at a byte offset; null where the bytes end before it."""
    places = range(start, start + size)
    digits = [F.hex(F.substring(content, p + 1, 1)) for p in (reversed(places) if little else places)]
    whole = F.length(content) >= start + size
    return F.when(whole, F.conv(F.concat(*digits), 16, 10).cast("bigint"))


def _signed(number: Column) -> Column:
    return F.when(number >= 2**31, number - 2**32).otherwise(number)


def fixed_size(content: Column) -> Column:
    """Struct (width, height) of a PNG, GIF, BMP or WebP file; null for all others."""

    def number(start: int, size: int, little: bool = True) -> Column:
        return _unsigned(content, start, size, little)

    def size(width: Column, height: Column) -> Column:
        both = F.struct(width.alias("width"), height.alias("height"))
        return F.when(width.isNotNull() & height.isNotNull(), both)

    def is_at(start: int, mark: bytes) -> Column:
        return F.substring(content, start + 1, len(mark)) == F.lit(bytearray(mark))

    side = (1 << WEBP_SIDE_BITS) - 1
    packed = number(21, 4)
    webp = (
        F.when(is_at(8, WEBP_LOSSY), size(number(26, 2).bitwiseAND(F.lit(side)), number(28, 2).bitwiseAND(F.lit(side))))
        .when(
            is_at(8, WEBP_LOSSLESS),
            size(
                packed.bitwiseAND(F.lit(side)) + 1,
                F.shiftright(packed, WEBP_SIDE_BITS).bitwiseAND(F.lit(side)) + 1,
            ),
        )
        .when(is_at(8, WEBP_EXTENDED), size(number(24, 3) + 1, number(27, 3) + 1))
    )
    bmp = F.when(number(14, 4) == BMP_OS2_HEADER, size(number(18, 2), number(20, 2))).otherwise(
        size(_signed(number(18, 4)), F.abs(_signed(number(22, 4))))
    )
    gif = starts_with(content, GIF_MAGICS[0]) | starts_with(content, GIF_MAGICS[1])
    return (
        F.when(starts_with(content, PNG_MAGIC), F.when(is_at(12, PNG_FIRST_CHUNK), size(number(16, 4, False), number(20, 4, False))))
        .when(gif, size(number(6, 2), number(8, 2)))
        .when(starts_with(content, BMP_MAGIC), bmp)
        .when(starts_with(content, RIFF_MAGIC), webp)
    )


def _number(content: Column, start: Column, size: int, little: bool) -> Column:
    """The same at an offset that is a column."""
    first = start.cast("int") + 1
    digits = [F.hex(F.substr(content, first + i, F.lit(1))) for i in range(size)]
    value = F.conv(F.concat(*(reversed(digits) if little else digits)), 16, 10).cast("bigint")
    return F.when((start >= 0) & (start + size <= F.length(content)), value)


def _followed(content: Column) -> Column:
    """Struct (pos, width, height) after the walk over a JPEG's marker segments; pos is below zero once it is over."""
    frames, bare = ([f"{m:02X}" for m in sorted(marks)] for marks in (JPEG_FRAMES, JPEG_BARE))

    def at(pos: Column, width: Column | None = None, height: Column | None = None) -> Column:
        none = F.lit(None).cast("bigint")
        width, height = none if width is None else width, none if height is None else height
        return F.struct(pos.cast("bigint").alias("pos"), width.alias("width"), height.alias("height"))

    def step(state: Column, _: Column) -> Column:
        pos = state["pos"]
        # marker, length of the segment, and in a frame its precision, height and width
        head = F.hex(F.substr(content, pos.cast("int") + 1, F.lit(9)))
        marker = F.substring(head, 3, 2)

        def digits(start: int) -> Column:
            return F.conv(F.substring(head, start, 4), 16, 10).cast("bigint")

        over = at(F.lit(-1))
        return (
            F.when(pos < 0, state)
            .when((pos >= F.length(content)) | ~head.startswith("FF") | (F.length(head) < 4), over)
            .when(marker.isin(frames), F.when(F.length(head) == 18, at(F.lit(-1), digits(15), digits(11))).otherwise(over))
            .when(marker == "FF", at(pos + 1))
            .when(marker.isin(bare), at(pos + 2))
            .when(F.length(head) < 8, over)
            .otherwise(at(pos + 2 + digits(5)))
        )

    def repeated(inner: Callable[[Column, Column], Column], times: int) -> Callable[[Column, Column], Column]:
        def loop(state: Column, _: Column) -> Column:
            return F.when(state["pos"] < 0, state).otherwise(
                F.aggregate(F.sequence(F.lit(1), F.lit(times)), state, inner)
            )

        return loop

    first = repeated(step, FIRST_STEPS)
    rest = step
    for _ in range(3):
        rest = repeated(rest, MORE_STEPS)
    return F.aggregate(F.array(F.lit(0), F.lit(1)), at(F.lit(2)), lambda state, i: F.when(i == 0, first(state, i)).otherwise(rest(state, i)))


def _directory(content: Column, little: bool) -> Column:
    """Struct (width, height) from a TIFF's first image directory."""
    start = _number(content, F.lit(4), 4, little)
    fields = _number(content, start, 2, little)
    whole = (fields == 0) | (start + 2 + 12 * (fields - 1) + 4 <= F.length(content))
    entries = F.transform(F.sequence(F.lit(0), fields - 1), lambda i: start + 2 + 12 * i)

    def side(number: int) -> Column:
        named = F.filter(
            entries,
            lambda e: (_number(content, e, 2, little) == number) & _number(content, e + 2, 2, little).isin(TIFF_SHORT, TIFF_LONG),
        )
        last = F.get(F.slice(named, -1, 1), F.lit(0))
        short = _number(content, last + 2, 2, little) == TIFF_SHORT
        return F.when(short, _number(content, last + 8, 2, little)).otherwise(_number(content, last + 8, 4, little))

    found = F.struct(side(TIFF_WIDTH).alias("width"), side(TIFF_LENGTH).alias("height"))
    both = F.filter(F.array(found), lambda f: f["width"].isNotNull() & f["height"].isNotNull())
    return F.when(whole & (fields > 0), F.get(both, F.lit(0)))


def chained_sides(content: Column) -> Column:
    """Struct (width, height) of a JPEG or TIFF file; null for all others, or with nulls where it is not told."""
    walked = F.when(starts_with(content, JPEG_MAGIC), _followed(content))
    jpeg = F.transform(F.array(walked), lambda w: F.struct(w["width"].alias("width"), w["height"].alias("height")))
    return (
        F.when(starts_with(content, JPEG_MAGIC), F.get(jpeg, F.lit(0)))
        .when(starts_with(content, TIFF_MAGICS[0]), _directory(content, True))
        .when(starts_with(content, TIFF_MAGICS[1]), _directory(content, False))
    )
