"""Score vectors into ranked tags per category. Native columns only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.joins import lookup_join
from shelfmark.schema import ALLOWED_CATEGORIES, DEFAULT_THRESHOLD, UNKNOWN_CATEGORY

TAG_SCORES = "array<struct<tag:string,score:double>>"


def passes(score: Column, threshold: float) -> Column:
    """At or above the threshold, compared as 32-bit floats. NaN does not pass."""
    return (score >= F.lit(threshold).cast("float")) & ~F.isnan(score)


def join_vocab(
    hits: DataFrame, vocab: DataFrame, keys: Sequence[str], vocab_bytes: int | None = None
) -> DataFrame:
    """Rows (keys, category, tag, score, idx) from rows (keys, idx, score).

    Positions outside the vocabulary give no tag; tags without a category become ``unknown``.
    """
    tags = lookup_join(hits, vocab.select("idx", "tag", "category"), ["idx"], "inner", vocab_bytes)
    return tags.select(
        *keys,
        F.coalesce("category", F.lit(UNKNOWN_CATEGORY)).alias("category"),
        F.col("tag").cast("string").alias("tag"),
        "score",
        "idx",
    )


def decode_hits(
    rows: DataFrame, vocab: DataFrame, keys: Sequence[str], vocab_bytes: int | None = None
) -> DataFrame:
    """Tags of rows that carry only the passing scores, with their ``positions``."""
    cells = F.arrays_zip(F.col("positions").alias("idx"), F.col("scores").alias("score"))
    hits = rows.select(*keys, F.inline(cells)).withColumn("score", F.col("score").cast("double"))
    return join_vocab(hits, vocab, keys, vocab_bytes)


def decode_scores(
    scored: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    threshold: float = DEFAULT_THRESHOLD,
    scores: str = "scores",
    vocab_bytes: int | None = None,
) -> DataFrame:
    """Tags of rows that carry a score vector. The threshold comes before the vocabulary join."""
    cells = scored.select(*keys, F.posexplode(scores).alias("idx", "_v"))
    hits = cells.where(passes(F.col("_v"), threshold)).select(
        *keys, "idx", F.col("_v").cast("double").alias("score")
    )
    return join_vocab(hits, vocab, keys, vocab_bytes)


def rank_tags(tags: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Add ``rank`` inside each category: score descending, ties in vocabulary order."""
    order = Window.partitionBy(*keys, "category").orderBy(F.col("score").desc(), F.col("idx"))
    return tags.withColumn("rank", F.row_number().over(order))


def top_tags(tags: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """First tag of each category, combined before the shuffle."""
    best = F.max_by(F.struct("tag", "score"), F.struct("score", -F.col("idx")))
    return tags.groupBy(*keys, "category").agg(best.alias("_best")).select(*keys, "category", "_best.*")


def allowed_tags(tags: DataFrame) -> DataFrame:
    """The typed view: only the five named categories."""
    return tags.where(F.col("category").isin(*ALLOWED_CATEGORIES))


def nest_tags(tags: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per category with its ordered list of (tag, score).

    A list is bounded by the vocabulary.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("_order"), "idx", "tag", "score"))
    )
    return (
        tags.groupBy(*keys, "category")
        .agg(ordered.alias("_tags"))
        .select(
            *keys,
            "category",
            F.transform("_tags", lambda t: F.struct(t["tag"].alias("tag"), t["score"].alias("score"))).alias(
                "tags"
            ),
        )
    )


def tag_results(tags: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per image with a map from category to its ordered list of (tag, score).

    One shuffle: tags are sorted per image and split by category in place.
    """
    cells = F.collect_list(
        F.struct((-F.col("score")).alias("_order"), "idx", "category", "tag", "score")
    )
    categories = F.array_distinct("_tags.category")

    def of_category(category: Column) -> Column:
        members = F.filter("_tags", lambda t: t["category"] == category)
        return F.transform(members, lambda t: F.struct(t["tag"].alias("tag"), t["score"].alias("score")))

    return (
        tags.groupBy(*keys)
        .agg(F.array_sort(cells).alias("_tags"))
        .select(
            *keys, F.map_from_arrays(categories, F.transform(categories, of_category)).alias("tags")
        )
    )


def head_tag(tags: Column) -> Column:
    """First element of an ordered list, null when it is empty."""
    return F.get(tags, 0)


def explode_results(
    results: DataFrame, keys: Sequence[str] = ("image_id",), tags: str = "tags"
) -> DataFrame:
    """Long rows (keys, category, tag, score) of every category in a result map."""
    return (
        results.select(*keys, F.explode(tags).alias("category", "_list"))
        .select(*keys, "category", F.inline(F.col("_list").cast(TAG_SCORES)))
        .select(*keys, "category", "tag", "score")
    )


def to_tag_rows(tags: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Rows shaped like the model tag table, after the ``kept`` columns; a fresh tag is never archived."""
    return tags.select(*kept, "image_id", "category", "tag", "score", F.lit(False).alias("archived"))
