"""Queries over a stored catalogue, on documents some of which a catalogue cannot hold, or have no size."""

from __future__ import annotations

import os

import duckdb
import pytest
from builders import IMAGE_COLUMNS, image_row, rows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from shelfmark.errors import InvalidRowError
from tools import compare

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = [(i, f"word {i * i}\n" * (i % 50 + 1), "en", f"src{i % 3}", 10 * i + 3) for i in range(1, 121)]
STORED = [
    *PROSE,
    *[(200 + i, PROSE[i][1], "fr", "copy", PROSE[i][4]) for i in range(5)],
    (300, "", "en", "src0", 0),
    (301, "", "de", "src1", 0),
    (302, "size not known", "en", "src0", None),
    (303, "size\nnot known", "en", "src0", None),
]
SKIPPED = [
    (400, None, "en", "src0", 9),
    (401, None, "en", "src1", None),
    (402, "no language", None, "src0", 11),
    (403, "no source", "en", None, 9),
    (None, "no number", "en", "src0", 9),
    (404, PROSE[7][1], None, "copy of one with a location", PROSE[7][4]),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(STORED + SKIPPED, DOCUMENTS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def duck(folder):
    duck = duckdb.connect()
    files = os.path.join(folder, "documents.parquet", "*.parquet")
    duck.execute(
        f"CREATE VIEW documents AS SELECT * FROM '{files}' "
        "WHERE text IS NOT NULL AND doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL"
    )
    return duck


@pytest.mark.parametrize("name", ["bucket_lookups", "commit_atomic", "registry_changes", "registry_notes", "registry_tags"])
def test_odd_documents_do_not_end_the_run(spark, duck, folder, name):
    """All documents with a text and a location are in the result as the SQL has them, sizes of zero or none included."""
    df = contract.queries()[name](spark, folder)
    assert compare.differences(df, df.collect(), duck.execute(contract.oracle_sql()[name])) == []


def test_counted_sides_may_be_zero_or_unknown_but_not_negative(spark, registry):
    data = [image_row("a", "a", 0, 1), image_row("b", "b", None, 2), image_row("c", "c", 2**31 - 1, 0)]
    new = spark.createDataFrame(data, IMAGE_COLUMNS)
    for row in ("a", "b", "c"):
        with pytest.raises(InvalidRowError):
            registry.add_images(new.where(F.col("file_location") == f"shelf/{row}"))
    registry.add_images(new, counted=True)
    assert rows(registry.images(), "image_id", "width", "height") == [(1, 0, 1), (2, None, 2), (3, 2**31 - 1, 0)]
    for column, value in (("width", -1), ("hash", "XYZ"), ("file_location", " "), ("file_location", None)):
        kind = dict(new.dtypes)[column]
        with pytest.raises(InvalidRowError):
            registry.add_images(new.withColumn(column, F.lit(value).cast(kind)), counted=True)
