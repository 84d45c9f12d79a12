"""Lookups, listings and counts over the catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.dedup import with_hashes
from shelfmark.operators.joins import lookup_join
from shelfmark.schema import LISTING_ROWS


def by_id(rows: DataFrame, image_id: int) -> DataFrame:
    """Rows of one image: itself, its tags or its note."""
    return rows.where(F.col("image_id") == image_id)


def by_hashes(images: DataFrame, hashes: DataFrame | Sequence[str] | str) -> DataFrame:
    """Images with the given hashes; an empty list gives no row.

    A Python list becomes a pushed-down IN; any larger set comes as a DataFrame.
    """
    if isinstance(hashes, DataFrame):
        return with_hashes(images, hashes)
    wanted = [hashes] if isinstance(hashes, str) else list(hashes)
    return images.where(F.col("hash").isin(wanted)) if wanted else images.limit(0)


def contains(images: DataFrame, image_id: int) -> DataFrame:
    """One row saying whether the id exists."""
    return by_id(images, image_id).agg((F.count(F.lit(1)) > 0).alias("found"))


def count_rows(rows: DataFrame, name: str = "n") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def listing(rows: DataFrame, *key: str | Column, limit: int = LISTING_ROWS) -> DataFrame:
    """The first rows in key order."""
    return rows.orderBy(*key).limit(limit)


def active_tags(tags: DataFrame) -> DataFrame:
    return tags.where(~F.coalesce("archived", F.lit(False)))


def all_tags(model_tags: DataFrame, manual_tags: DataFrame) -> DataFrame:
    """Model and manual tags in one table; manual ones have no score and no archive mark."""
    return model_tags.withColumn("source", F.lit("model")).unionByName(
        manual_tags.withColumn("source", F.lit("manual")), allowMissingColumns=True
    )


def images_by_tag(images: DataFrame, tags: DataFrame, tag: str, category: str) -> DataFrame:
    """Images that carry the tag."""
    tagged = tags.where((F.col("category") == category) & (F.col("tag") == tag))
    return images.join(tagged.select("image_id"), "image_id", "left_semi")


def images_by_tags(images: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images that carry any of the wanted (tag, category) pairs."""
    pairs = wanted.select("tag", "category").distinct()
    tagged = lookup_join(tags, pairs, ["tag", "category"], "left_semi")
    return images.join(tagged.select("image_id").distinct(), "image_id", "left_semi")
