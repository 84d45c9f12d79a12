"""Outcome of tagging, per file and in total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUCCESS, FAILURE, EMPTY = "success", "failure", "empty"


def outcome_column(error: Column, tags: Column) -> Column:
    return F.when(error.isNotNull(), FAILURE).when(tags == 0, EMPTY).otherwise(SUCCESS)


def classify(scored: DataFrame, tags: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Scored files with ``n_tags`` and ``outcome``.

    Tags are counted per file before the join, in every category. Files and results meet by key.
    """
    counts = tags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tags"))
    n_tags = F.coalesce("n_tags", F.lit(0))
    return (
        scored.join(counts, list(keys), "left")
        .withColumn("n_tags", n_tags)
        .withColumn("outcome", outcome_column(F.col(error), F.col("n_tags")))
    )


def count_columns() -> list[Column]:
    """A count per outcome (zero included), the total, and whether any succeeded."""
    outcome = F.col("outcome")
    return [
        F.count_if(outcome == SUCCESS).alias("success"),
        F.count_if(outcome == FAILURE).alias("failure"),
        F.count_if(outcome == EMPTY).alias("empty"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.bool_or(outcome == SUCCESS), F.lit(False)).alias("any_success"),
    ]


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(*count_columns())
