"""Table layouts of the catalogue, with the fixed names and defaults that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The five categories of the typed view of a tag result, in display order.
ALLOWED_CATEGORIES = ("rating", "copyright", "character", "artist", "general")

# Category of a tag the vocabulary does not place, and the score threshold in effect.
UNKNOWN_CATEGORY = "unknown"
DEFAULT_THRESHOLD = 0.0

# Files per micro-batch and rows shown by the listings.
FILES_PER_BATCH = 1000
LISTING_ROWS = 20

IMAGES = T.StructType(
    [
        T.StructField("image_id", T.LongType(), False),
        T.StructField("file_location", T.StringType(), False),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("hash", T.StringType(), False),
        T.StructField("file_size", T.LongType()),
        T.StructField("added_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

MODEL_TAGS = T.StructType(
    [
        T.StructField("image_id", T.LongType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("score", T.DoubleType()),
        T.StructField("archived", T.BooleanType()),
    ]
)

MANUAL_TAGS = T.StructType(
    [
        T.StructField("image_id", T.LongType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("tag", T.StringType(), False),
    ]
)

NOTES = T.StructType(
    [
        T.StructField("image_id", T.LongType(), False),
        T.StructField("content", T.StringType()),
    ]
)

# Columns a caller supplies for a new image; id and timestamps are given by the registry.
NEW_IMAGE_COLUMNS = ("file_location", "width", "height", "file_type", "hash", "file_size")
# Columns a bulk update may change; hash and added_at never change.
UPDATABLE_COLUMNS = ("file_location", "width", "height", "file_type", "file_size")


@dataclass(frozen=True)
class Table:
    """One catalogue table: its columns, its key, the order of rows inside its files, and the column by which
    its rows are dealt to buckets where that is asked for."""

    schema: T.StructType
    key: tuple[str, ...]
    sort: tuple[str, ...]
    bucket: str = "image_id"

    @property
    def columns(self) -> list[str]:
        return self.schema.names


TAG_KEY = ("image_id", "category", "tag")

TABLES: dict[str, Table] = {
    "images": Table(IMAGES, ("image_id",), ("image_id",), "hash"),
    "model_tags": Table(MODEL_TAGS, TAG_KEY, ("category", "tag", "image_id")),
    "manual_tags": Table(MANUAL_TAGS, TAG_KEY, ("category", "tag", "image_id")),
    "notes": Table(NOTES, ("image_id",), ("image_id",)),
}
