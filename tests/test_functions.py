from __future__ import annotations

import hashlib
import random
import struct

import pytest
from builders import bmp, bmp_os2, gif, jpeg, png, rows, tiff, webp
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.functions.images import CHAIN_PREFIX, CutShort, chained_size
from shelfmark.operators.metadata import (
    extract_metadata,
    probe_dimensions,
    skipped_files,
    valid_files,
)

BUILDERS = [
    png, gif, bmp, lambda w, h: bmp(w, -h), bmp_os2, jpeg,
    *[lambda w, h, kind=kind: webp(kind, w, h) for kind in (b"VP8 ", b"VP8L", b"VP8X")],
    tiff, lambda w, h: tiff(w, h, ">"),
]


def _sizes(spark, contents):
    data = [(i, c) for i, c in enumerate(contents)]
    found = probe_dimensions(spark.createDataFrame(data, "i int, content binary"))
    return [(r.width, r.height) for r in found.orderBy("i").collect()]


def test_every_format_gives_its_size(spark):
    sides = [(1, 1), (30, 20), (255, 256), (16000, 9999)]
    contents = [build(w, h) for build in BUILDERS for w, h in sides]
    assert _sizes(spark, contents) == sides * len(BUILDERS)


def test_a_header_cut_short_is_no_error(spark):
    contents = [build(30, 20)[:length] for build in BUILDERS for length in range(41)]
    assert set(_sizes(spark, contents)) == {(None, None), (30, 20)}


def test_any_bytes_are_no_error(spark):
    random = [hashlib.sha256(bytes([i])).digest() * 3 for i in range(40)]
    magics = (b"", b"\xff\xd8\xff", b"II*\x00", b"RIFF1234WEBPVP8X", b"BM", b"\x89PNG\r\n\x1a\n")
    contents = [magic + data for magic in magics for data in random] + [b"", None]
    assert len(_sizes(spark, contents)) == len(contents)


@given(st.binary(max_size=200))
def test_chains_of_any_bytes_give_a_size_or_ask_for_more(data):
    for magic in (b"", b"\xff\xd8\xff", b"II*\x00", b"MM\x00*"):
        try:
            chained_size(magic + data)
        except CutShort:
            pass


def test_long_jpeg_headers_are_followed_to_their_end(spark):
    app = b"\xff\xe1\xff\xff" + bytes(65533)
    chain = b"\xff\xd8" + app * 80 + jpeg(640, 480)[2:]  # some 5 MB of segments
    assert _sizes(spark, [jpeg(640, 480, app_bytes=60000), chain]) == [(640, 480)] * 2
    assert len(chain) > CHAIN_PREFIX


def _told(data):
    try:
        return chained_size(data) or (None, None)
    except CutShort:
        return None, None


def test_columns_follow_chains_as_tasks_do(spark):
    """Random segments, fill bytes, bare markers, tables of fields, and all of these cut short."""
    rng = random.Random(6)

    def segment():
        kind = rng.choice([0xC0, 0xC2, 0xC4, 0xC8, 0xD0, 0xD8, 0x01, 0xE0, 0xE1, 0xFF, 0xFE, 0xDA])
        size = rng.choice([0, 1, 2, 4, 9, 300])
        return bytes([0xFF, kind, size >> 8, size & 255]) + rng.randbytes(rng.choice([0, 2, 5, 7, 298]))

    def field(order):
        number, kind = rng.choice([254, 256, 256, 257, 257, 258]), rng.choice([3, 3, 4, 4, 1])
        return struct.pack(order + "HHII", number, kind, 1, rng.randrange(1 << 32))

    contents = [b"\xff\xd8\xff\xe0\x00\x02" + b"".join(segment() for _ in range(rng.randint(0, 60))) for _ in range(300)]
    contents += [b"\xff\xd8" + b"\xff" * n + jpeg(7, 9)[2:] for n in (1, 50, 3000)]
    contents += [b"\xff\xd8\xff\xd0" + b"\xff\x01" * 40 + jpeg(5, 6)[2:]]
    for order, mark in (("<", b"II*\x00"), (">", b"MM\x00*")):
        for _ in range(150):
            gap, fields = rng.choice([0, 3]), [field(order) for _ in range(rng.randint(0, 8))]
            start = rng.choice([8 + gap] * 4 + [0, 5000, 2**32 - 1])
            told = len(fields) + rng.choice([0, 0, 0, 1, -1])
            contents.append(mark + struct.pack(order + "I", start) + bytes(gap) + struct.pack(order + "H", max(told, 0)) + b"".join(fields))
    contents += [c[: rng.randint(0, len(c))] for c in contents]
    wanted = [_told(c) for c in contents]
    assert _sizes(spark, contents) == wanted
    assert sum(w != (None, None) for w in wanted) > 100


def test_sizes_of_bytes_need_no_python(spark):
    df = spark.createDataFrame([(b"x",)], "content binary")
    plan = probe_dimensions(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(
    ("path", "extension"),
    [
        ("/a/b.PNG", "png"),
        ("/a/b.tar.png", "png"),
        ("/a/noext", ""),
        ("/a.d/noext", ""),
        ("/a/.hidden", ""),
        ("/a/b.", ""),
        ("s3://bucket/x.JPeG", "jpeg"),
    ],
)
def test_extension_is_the_lower_cased_last_suffix(spark, path, extension):
    df = spark.range(1).select(fn.file_extension(F.lit(path)))
    assert df.first()[0] == extension


def test_hash_is_the_sha256_of_the_bytes(spark):
    data = bytes(range(256))
    df = spark.createDataFrame([(data,)], "content binary").select(fn.content_hash(F.col("content")))
    assert df.first()[0] == hashlib.sha256(data).hexdigest()


def test_location_must_hold_more_than_white_space(spark):
    df = spark.createDataFrame([("a",), ("",), ("  ",), ("　\t",), (None,)], "p string")
    valid = [r[0] for r in df.select(fn.valid_location(F.col("p"))).collect()]
    assert valid == [True, False, False, False, False]


def test_hash_must_be_64_lower_case_hex_digits(spark):
    values = ["a" * 64, "a" * 63, "A" * 64, "g" * 64, "0x" + "a" * 62, "", None]
    df = spark.createDataFrame([(v,) for v in values], "h string")
    valid = [r[0] for r in df.select(fn.valid_hash(F.col("h"))).collect()]
    assert valid == [True] + [False] * 6


def test_sides_must_be_positive(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, -1), (None, 1)], "w int, h int")
    valid = [r[0] for r in df.select(fn.valid_size(F.col("w"), F.col("h"))).collect()]
    assert valid == [True, False, False, False]


def test_geometry(spark):
    df = spark.createDataFrame([(1920, 1080), (100000, 100000)], "w int, h int")
    ratio, pixels = fn.aspect_ratio(F.col("w"), F.col("h")), fn.total_pixels(F.col("w"), F.col("h"))
    assert rows(df.select(ratio, pixels)) == [(1.0, 10000000000), (1920 / 1080, 2073600)]


def _files(spark, *entries):
    data = [(path, len(content), content) for path, content in entries]
    return spark.createDataFrame(data, "path string, length bigint, content binary")


def test_metadata_of_files(spark):
    files = _files(
        spark,
        ("file:/x/a.PNG", png(3, 4)),
        ("file:/x/b.jpg", jpeg(5, 6)),
        ("file:/x/c.png", b"plain text"),
        ("file:/x/d.gif", gif(0, 6)),
        ("s3://bucket/e.bmp", bmp(7, 8)),
    )
    found = extract_metadata(files)
    assert rows(found, "file_location", "width", "height", "file_type", "status") == [
        ("/x/a.PNG", 3, 4, "png", "ok"),
        ("/x/b.jpg", 5, 6, "jpg", "ok"),
        ("/x/c.png", None, None, "png", "unsupported"),
        ("/x/d.gif", 0, 6, "gif", "size"),
        ("s3://bucket/e.bmp", 7, 8, "bmp", "ok"),
    ]
    assert valid_files(found).count() == 3
    assert rows(skipped_files(found), "file_location", "status") == [
        ("/x/c.png", "unsupported"),
        ("/x/d.gif", "size"),
    ]


def test_sizes_beyond_the_table_are_skipped(spark):
    found = extract_metadata(_files(spark, ("file:/x/a.png", png(2**31, 1)))).first()
    assert (found.status, found.width, found.height) == ("size", None, 1)


def test_probe_keeps_the_other_columns(spark):
    files = _files(spark, ("file:/x/a.png", png(3, 4)))
    assert probe_dimensions(files).columns == ["path", "length", "content", "width", "height"]
