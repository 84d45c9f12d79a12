"""Column expressions."""

from shelfmark.functions.columns import (
    aspect_ratio,
    content_hash,
    file_extension,
    plain_location,
    total_pixels,
    valid_hash,
    valid_location,
    valid_size,
    validity,
)

__all__ = [
    "aspect_ratio",
    "content_hash",
    "file_extension",
    "plain_location",
    "total_pixels",
    "valid_hash",
    "valid_location",
    "valid_size",
    "validity",
]
