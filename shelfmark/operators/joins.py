"""Joins against a lookup side: broadcast when its measured size allows, shuffled otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper size of a side that may be copied to every executor.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows, by one distributed aggregation: text by its length, the rest by width."""
    row = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        row = row + F.lit(16)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            row = row + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            row = row + F.octet_length(F.to_json(F.struct(F.col(field.name))))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    right_bytes: int | None = None,
) -> DataFrame:
    """Join a large left side with a lookup side: broadcast if small enough, shuffled otherwise.

    ``right_bytes`` is an upper bound of its size; the side is measured when the caller has none.
    Adaptive execution splits the left rows of a hot key in a shuffled join; a salt of our own cost
    more than it saved.
    """
    size = measured_bytes(right) if right_bytes is None else right_bytes
    return left.join(F.broadcast(right) if size <= MAX_BROADCAST_BYTES else right, list(on), how)
