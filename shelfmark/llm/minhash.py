"""MinHash fingerprints of documents.

Words of a text are hashed, five in a row make a shingle, and each of many universal hash functions
keeps its least value over the shingles. The share of equal places in two fingerprints estimates
the Jaccard similarity of the shingle sets. Pairs are found by joining bands of places in Spark and
are verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map, texts_of

SHINGLE_WORDS = 5
PLACES = 128
# 32 bands of four places: at a similarity of 0.8 all bands miss once in ten million pairs.
BANDS = 32
SIMILARITY = 0.8
# Shingles hashed at a time, so that the table of values stays in a processor's cache.
BLOCK = 2048
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PLACES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` words, A to Z in lower case; of a shorter text one
    for all its words, of a text without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = total * _STEP + hashed[i : i + len(total)]
    total ^= total >> np.uint64(32)
    return total * _MIX


def signature(text: bytes) -> np.ndarray:
    """16 bits for each place; a text without words has all bits set."""
    shingles = shingle_hashes(text)
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), BLOCK):
        part = shingles[start : start + BLOCK]
        least = np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return (least >> np.uint64(24)).astype("<u2")


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float((one == other).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, signature) for each document; null texts count as empty. Equal texts have equal signatures."""
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs, ["doc_id", "text"], f"doc_id {kind}, signature binary", lambda batch: {
        "doc_id": batch.column("doc_id"),
        "signature": pa.array([signature(t).tobytes() for t in texts_of(batch)], pa.binary()),
    })


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates: (doc_id, class_id) with class_id the least doc_id of equal texts, and pairs
    of classes (left_id, right_id, jaccard) with at least the given similarity.

    Only one document of each class enters the bands, so copies make no pairs. Candidates share a
    band and are verified on their shingle sets. Rows without doc_id are left out; texts without
    words link to no other.
    """
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = named.withColumn("key", F.sha2("text", 256))
    classes = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    members = keyed.select("doc_id", "key").distinct().join(classes, "key").select("doc_id", "class_id")
    leaders = classes.select(F.col("class_id").alias("doc_id"), "key")
    texts = keyed.join(leaders, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id"])
    rows = PLACES // BANDS
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, shingles binary, bands array<bigint>"

    def run(batch: pa.RecordBatch) -> dict:
        found = texts_of(batch)
        bands = []
        for text in found:
            cut = signature(text).reshape(BANDS, rows)
            named = [xxhash.xxh64_intdigest(bytes([i]) + band.tobytes()) for i, band in enumerate(cut)]
            bands.append(np.array(named, np.uint64).view(np.int64) if text.split() else [])
        shingles = [np.unique(shingle_hashes(t)).tobytes() for t in found]
        return {
            "doc_id": batch.column("doc_id"),
            "shingles": pa.array(shingles, pa.binary()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
        }

    signed = arrow_map(texts, ["doc_id", "text"], schema, run)
    banded = signed.select("doc_id", F.explode("bands").alias("band"))
    left = banded.withColumnRenamed("doc_id", "left_id")
    right = banded.withColumnRenamed("doc_id", "right_id")
    pairs = left.join(right, "band").where("left_id < right_id").select("left_id", "right_id").distinct()
    sets = signed.select("doc_id", "shingles")
    both = pairs.join(sets.toDF("left_id", "left_set"), "left_id").join(sets.toDF("right_id", "right_set"), "right_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for a, b in zip(batch.column("left_set").to_pylist(), batch.column("right_set").to_pylist(), strict=True):
                one, other = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                values.append(common / (len(one) + len(other) - common))
            columns = [batch.column("left_id"), batch.column("right_id"), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["left_id", "right_id", "jaccard"])

    kind = dict(docs.dtypes)["doc_id"]
    verified = both.select("left_id", "right_id", "left_set", "right_set").mapInArrow(
        verify, f"left_id {kind}, right_id {kind}, jaccard double"
    )
    return members, verified.where(F.col("jaccard") >= similarity)
