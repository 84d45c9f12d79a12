"""Column expressions for one catalogued file. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes as 64 lower-case hex digits."""
    return F.sha2(content, 256)


def file_extension(location: Column) -> Column:
    """Lower-cased last suffix without its dot; empty when the file name has none."""
    return F.lower(F.regexp_extract(location, r"(?<=[^/])\.([^./]+)$", 1))


def plain_location(path: Column) -> Column:
    """Local files lose their URI scheme, all other paths stay full URIs."""
    return F.regexp_replace(path, "^file:/+", "/")


def aspect_ratio(width: Column, height: Column) -> Column:
    return width.cast("double") / height.cast("double")


def total_pixels(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height.cast("bigint")


def valid_location(location: Column) -> Column:
    """Holds something other than white space, in the Unicode sense."""
    return F.coalesce(location.rlike(r"(?U)\S"), F.lit(False))


def valid_hash(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def valid_size(width: Column, height: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0), F.lit(False))


def validity(location: Column, hash_value: Column, width: Column, height: Column) -> Column:
    """First rule a row breaks (``location``, ``hash`` or ``size``), or ``ok``."""
    return (
        F.when(~valid_location(location), "location")
        .when(~valid_hash(hash_value), "hash")
        .when(~valid_size(width, height), "size")
        .otherwise("ok")
    )


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later steps use them.

    The optimizer copies the definition of a plain column into each filter and column above it.
    Unfolding a one-element array gives the same rows, and ends that.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
