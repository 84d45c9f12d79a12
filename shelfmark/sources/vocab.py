"""Vocabulary of a scorer: position in the score vector, tag and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.schema import UNKNOWN_CATEGORY

# Fixed layout of the vocabulary document: both maps sit below dataset_info.tag_mapping.
VOCAB_DOCUMENT = T.StructType(
    [
        T.StructField(
            "dataset_info",
            T.StructType(
                [
                    T.StructField(
                        "tag_mapping",
                        T.StructType(
                            [
                                T.StructField("tag_to_idx", T.MapType(T.StringType(), T.IntegerType())),
                                T.StructField("tag_to_category", T.MapType(T.StringType(), T.StringType())),
                            ]
                        ),
                    )
                ]
            ),
        )
    ]
)


def parse_vocab(documents: DataFrame, json: Column, *keys: str) -> DataFrame:
    """Rows (keys, idx, tag, category) of every vocabulary document in the column ``json``.

    A tag without a category becomes ``unknown``. Both maps of a document share its row, so the
    category is looked up in place, without a join.
    """
    maps = F.from_json(json, VOCAB_DOCUMENT)["dataset_info"]["tag_mapping"]
    return (
        documents.select(*keys, maps.alias("_maps"))
        .select(*keys, "_maps", F.explode("_maps.tag_to_idx").alias("tag", "idx"))
        .select(
            *keys,
            "idx",
            "tag",
            F.coalesce(
                F.try_element_at("_maps.tag_to_category", F.col("tag")), F.lit(UNKNOWN_CATEGORY)
            ).alias("category"),
        )
    )


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary from one JSON file."""
    return parse_vocab(spark.read.text(path, wholetext=True), F.col("value"))
