"""Inserts, upserts, updates and deletes as DataFrame to DataFrame functions.

The registry writes what these give; none of them knows how tables are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ids import assign_ids
from shelfmark.operators.joins import lookup_join
from shelfmark.schema import IMAGES, NEW_IMAGE_COLUMNS, UPDATABLE_COLUMNS


def numbered_images(new: DataFrame, start: int | Column, lot: str | None = None) -> DataFrame:
    """New image rows with ids from ``start`` and both timestamps set to now; with a column ``lot``, which stays,
    lot by lot."""
    now, kept = F.localtimestamp(), [lot] if lot else []
    numbered = assign_ids(new.select(*kept, *NEW_IMAGE_COLUMNS), start, lot=lot)
    stamped = numbered.withColumn("added_at", now).withColumn("updated_at", now)
    return stamped.select(*kept, *[F.col(f.name).cast(f.dataType) for f in IMAGES.fields])


def last_per_key(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one that is greatest in ``order``, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), order)
    return rows.groupBy(*key).agg(last.alias("_row")).select(*key, "_row.*").select(*rows.columns)


def one_per_key(batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Settle copies of a key inside one upsert batch: the highest score, then the greatest row."""
    rest = [c for c in batch.columns if c not in key]
    if not rest:
        return batch.distinct()
    ranked = sorted(rest, key=lambda c: c != "score")
    return last_per_key(batch, key, F.struct(*ranked))


def replaced(current: DataFrame, touched: DataFrame, live: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after changes: rows of touched keys give way to the live ones, all others stay."""
    return current.join(touched, list(key), "left_anti").unionByName(live)


def upsert(current: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the batch replace whole rows of the same key; all others stay."""
    settled = one_per_key(batch.select(*current.columns), key)
    return replaced(current, settled.select(*key), settled, key)


def changed_images(current: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions of the images named in ``changes``; unknown ids give no row.

    All updatable columns are taken from ``changes``, nulls included.
    """
    changes = one_per_key(changes.select("image_id", *UPDATABLE_COLUMNS), ["image_id"])
    kept = current.drop(*UPDATABLE_COLUMNS)
    if "updated_at" in kept.columns:
        kept = kept.withColumn("updated_at", F.localtimestamp())
    return lookup_join(kept, changes, ["image_id"]).select(*current.columns)


def update_images(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The images table after a bulk update."""
    changed = changed_images(current, changes)
    return replaced(current, changed.select("image_id"), changed, ["image_id"])


def remove_rows(current: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows whose id is not in ``ids``; ids that do not occur are ignored."""
    gone = ids.select(key).distinct()
    return replaced(current, gone, current.limit(0), [key])


def removed_counts(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """Number of tag rows each image in ``ids`` would lose, zero included."""
    counts = tags.groupBy("image_id").agg(F.count(F.lit(1)).alias("removed"))
    wanted = ids.select("image_id").distinct()
    return wanted.join(counts, "image_id", "left").select(
        "image_id", F.coalesce("removed", F.lit(0)).alias("removed")
    )
