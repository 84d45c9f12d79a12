"""The catalogue's inputs, made from the test tables.

The test data holds no media files, so every table plays a part: documents are the files,
embeddings the score vectors (vector i belongs to document i), part is the vocabulary, and
documents with a label are the ones registered already.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.columns import content_hash, file_extension
from shelfmark.operators.dedup import keep_first
from shelfmark.operators.tags import decode_scores, to_tag_rows
from shelfmark.session import staged

# Score threshold that leaves some files without any tag.
THRESHOLD = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def location(extension: str = ".TXT") -> Column:
    return F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(extension))


def lines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: width is the number of characters, height the number of lines."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"),
        location().alias("file_location"),
        F.col("n_chars").cast("int").alias("width"),
        lines(text).cast("int").alias("height"),
        file_extension(location()).alias("file_type"),
        content_hash(text.cast("binary")).alias("hash"),
        F.octet_length(text).cast("bigint").alias("file_size"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "image_id")


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as the files registered before: one row per hash."""
    return keep_first(assets(spark, sf_dir).join(labels(spark, sf_dir), "image_id", "left_semi"))


def storable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files to store, one for each content.

    A document without a text has no content and no hash, one without an id, source or language no location: such
    files are skipped, as ``register`` skips them, so that they do not end the run of all others. Sizes may be zero
    or unknown, since they count characters and lines.
    """
    files = assets(spark, sf_dir).where("file_location IS NOT NULL AND file_size IS NOT NULL")
    return keep_first(files.drop("image_id"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tags. Part types stand for categories; some large parts have none."""
    kind = F.col("p_type")
    category = (
        F.when(kind == "ECONOMY", "rating")
        .when(kind == "STANDARD", "copyright")
        .when(kind == "PROMO", "character")
        .when(kind == "SMALL", "artist")
        .when(kind == "MEDIUM", "general")
        .when((kind == "LARGE") & (F.col("p_size") > 25), "meta")
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("idx"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("tag"),
        category.alias("category"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("embedding").alias("scores")
    )


def decoded(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return decode_scores(scores(spark, sf_dir), vocab(spark, sf_dir), ["image_id"], threshold)


def model_tags(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return to_tag_rows(decoded(spark, sf_dir, threshold))


def scored_files(files: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the score vector of the same number; a file without one has failed."""
    joined = files.join(scores(spark, sf_dir), "image_id", "left")
    return joined.withColumn("error", F.when(F.col("scores").isNull(), "no result"))


def _little_endian(value: Column) -> Column:
    digits = F.lpad(F.hex(value), 8, "0")
    return F.concat(*[F.substring(digits, start, 2) for start in (7, 5, 3, 1)])


def as_image(documents: DataFrame) -> DataFrame:
    """Documents as scanned image files: a header of the right size before the text.

    English is PNG, French BMP, German JPEG (16-bit sizes); Spanish has no header at all.
    """
    width, height = F.col("n_chars"), lines(F.col("text"))
    short = F.lit(65535)
    png = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(width), 8, "0"), F.lpad(F.hex(height), 8, "0")
    )
    bmp = F.concat(
        F.lit("424D00000000000000000000000028000000"), _little_endian(width), _little_endian(height)
    )
    jpeg = F.concat(
        F.lit("FFD8FFE000040000FFC0001108"),
        F.lpad(F.hex(F.least(height, short)), 4, "0"),
        F.lpad(F.hex(F.least(width, short)), 4, "0"),
    )
    lang = F.col("lang")
    header = F.when(lang == "en", png).when(lang == "fr", bmp).when(lang == "de", jpeg).otherwise("")
    return (
        documents.select(
            F.concat(F.lit("file:"), location(".Png")).alias("path"),
            F.concat(F.unhex(header), F.col("text").cast("binary")).alias("content"),
        )
        .withColumn("length", F.length("content").cast("bigint"))
        .select("path", "length", "content")
    )


# Every so many-th document is written as a file without content.
EMPTY_EVERY = 97


def write_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Documents as real image files below a folder, written in tasks. Some names begin with _ or a dot,
    and some files are empty."""
    number = F.regexp_extract("path", r"(\d+)\.Png$", 1).cast("bigint")
    front = F.when(number % 5 == 0, "_").when(number % 5 == 1, ".").otherwise("")
    content = F.when(number % EMPTY_EVERY != 0, F.col("content"))
    place = F.regexp_replace(F.regexp_replace("path", "^file:", ""), r"\d+\.Png$", "")
    files = as_image(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit(folder), place, front, number, F.lit(".Png")).alias("path"), content.alias("content")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                inner = root.rstrip("/") + path.removeprefix(folder)
                place = os.path.dirname(inner)
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                with system.open_output_stream(inner) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
            yield batch.select(["path"])

    staged(files.mapInArrow(run, "path string"), "written")


# Letters whose share of the bytes is the score of the test scorer, in vocabulary order.
LETTERS = b"aeiou"
SHORTEST = 64


def letter_scorer():
    """Test scorer: share of each vowel among the bytes; files below SHORTEST bytes fail."""

    def score(contents: Sequence[bytes]) -> list:
        shares = []
        for content in contents:
            if len(content) < SHORTEST:
                shares.append(ValueError("too short"))
                continue
            found = np.bincount(np.frombuffer(content, dtype=np.uint8), minlength=256)
            shares.append((found[list(LETTERS)] / len(content)).astype(np.float32))
        return shares

    return score
