"""Copies: against the registry, within a batch, and as a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.errors import DuplicateImageError
from shelfmark.operators import joins

# Size of one hash row: 64 digits and its overhead.
HASH_ROW_BYTES = 80


def against_registry(
    incoming: DataFrame, registered: DataFrame, registered_rows: int | None = None, most_bytes: int | None = None
) -> DataFrame:
    """Incoming rows whose hash is not registered. Copies inside ``incoming`` all stay.

    A small registry is broadcast. With a large one a small batch looks up its own hashes: one
    scan of the registry's hashes, without a shuffle. Of two large sides both are shuffled, or the incoming
    one alone if the registry is stored in buckets by hash (``Registry.compact``). ``registered_rows`` is an
    upper bound of the registry's rows, if the caller knows one; ``most_bytes`` what may be broadcast.
    """
    most_bytes = joins.MAX_BROADCAST_BYTES if most_bytes is None else most_bytes
    hashes = registered.select("hash")
    rows = hashes.count() if registered_rows is None else registered_rows
    if rows * HASH_ROW_BYTES <= most_bytes:
        return incoming.join(F.broadcast(hashes), "hash", "left_anti")
    if incoming.count() * HASH_ROW_BYTES <= most_bytes:
        candidates = incoming.select("hash").distinct()
        known = hashes.join(F.broadcast(candidates), "hash", "left_semi")
        # Known hashes are some of the candidates, so they are no larger.
        return incoming.join(F.broadcast(known), "hash", "left_anti")
    return incoming.join(hashes.hint("merge"), ["hash"], "left_anti")


def with_hashes(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows whose hash is among ``hashes``."""
    return joins.lookup_join(rows, hashes.select("hash").distinct(), ["hash"], "left_semi")


def keep_first(rows: DataFrame, key: str | Sequence[str] = "hash", order: str = "file_location") -> DataFrame:
    """One row per hash, or other key, the one with the smallest location.

    An aggregation, so copies are combined before the shuffle however many one hash has.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest)))
    return rows.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def duplicate_hashes(rows: DataFrame) -> DataFrame:
    """Hashes that occur more than once, with their number of rows."""
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def within_batch(rows: DataFrame, on_duplicate: str = "keep_first") -> DataFrame:
    """Apply the batch rule: ``keep_first``, or ``error`` to refuse a batch that holds copies."""
    if on_duplicate == "keep_first":
        return keep_first(rows)
    if on_duplicate != "error":
        raise ValueError(f"on_duplicate must be 'keep_first' or 'error', not {on_duplicate!r}")
    if not duplicate_hashes(rows).isEmpty():
        raise DuplicateImageError("the batch holds the same hash more than once")
    return rows
