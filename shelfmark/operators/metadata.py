"""Metadata of scanned files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.columns import (
    content_hash,
    evaluated,
    file_extension,
    plain_location,
    valid_location,
    valid_size,
)
from shelfmark.functions.images import chained_sides, fixed_size
from shelfmark.sources.files import TOO_LARGE, probe_files

# Largest width or height the images table can hold.
MAX_SIDE = 2**31 - 1


def probe_dimensions(df: DataFrame, content: str = "content") -> DataFrame:
    """Add (width, height) read from the image header; both null for an unknown format."""
    bytes_ = F.col(content)
    told = evaluated(df, _sides=F.coalesce(fixed_size(bytes_), chained_sides(bytes_)))
    return told.withColumns({side: F.col(f"_sides.{side}") for side in ("width", "height")}).drop("_sides")


def extraction_status(
    location: Column, width: Column, height: Column, error: Column | None = None, length: Column | None = None
) -> Column:
    """``ok``, or why a file is skipped: ``too_large``, ``unreadable``, ``empty``, ``unsupported``,
    ``size`` or ``location``."""
    error = F.lit(None) if error is None else error
    length = F.lit(None) if length is None else length
    return (
        F.when(error == TOO_LARGE, "too_large")
        .when(error.isNotNull(), "unreadable")
        .when(length == 0, "empty")
        .when(width.isNull() | height.isNull(), "unsupported")
        .when(~valid_size(width, height) | (F.greatest(width, height) > MAX_SIDE), "size")
        .when(~valid_location(location), "location")
        .otherwise("ok")
    )


def extract_metadata(files: DataFrame) -> DataFrame:
    """One pass over files with their bytes: (path, location, size, type, hash, file size, status).

    ``content`` does not leave this stage. A file that cannot be read as an image keeps its row
    with a status other than ``ok``, so a run goes on and the skipped files can be listed; where the
    scan tells an ``error``, the row has it too.
    """
    told = ["error"] if "error" in files.columns else []
    hashed = evaluated(
        files.select("path", "length", "content", *told), hash=content_hash(F.col("content"))
    )
    return _metadata(probe_dimensions(hashed))


def file_metadata(files: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """The same, with ``error``, of listed files (path): each is read once, in its task, whatever
    its size. ``kept`` columns of the files come first."""
    probed = evaluated(probe_files(files, kept), _fixed=fixed_size(F.col("header")))
    return _metadata(probed.withColumns({s: F.coalesce(f"_fixed.{s}", s) for s in ("width", "height")}), kept)


def _metadata(probed: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    location = plain_location(F.col("path"))
    told = [F.col("error")] if "error" in probed.columns else []
    return probed.select(
        *kept,
        "path",
        location.alias("file_location"),
        F.when(F.col("width") <= MAX_SIDE, F.col("width")).cast("int").alias("width"),
        F.when(F.col("height") <= MAX_SIDE, F.col("height")).cast("int").alias("height"),
        file_extension(location).alias("file_type"),
        "hash",
        F.col("length").alias("file_size"),
        extraction_status(
            location, F.col("width"), F.col("height"), told[0] if told else None, F.col("length") if told else None
        ).alias("status"),
        *told,
    )


def valid_files(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("status") == "ok").drop("status", "error")


def skipped_files(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("status") != "ok")

