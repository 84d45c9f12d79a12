"""Fingerprints of documents beside an edited form of each, which borrows from the next document.

Next is the document with the next smaller doc_id, and after the last the first. Documents are
dealt to blocks by ranges of doc_id, sorted there, and read as a stream; the last document of the
range before is dealt to each block as well, so that texts move once. A doc_id, or the lack of one, that
holds many rows is cut into ranges of their texts' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.minhash import likeness, signature
from shelfmark.llm.common import texts_of

NO_ID = -(2**63)
# Blocks for each shuffle partition, and the accuracy of their bounds.
BLOCKS_PER_PARTITION = 4
BOUND_ERROR = 10
RESULT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 3) code points replaced by as many first ones of
    the next document, or all it has. Null texts are empty. Rows that repeat a doc_id are ordered by
    the hash of their text; rows without doc_id come last, ordered alike. A table of one row has itself as
    next, an empty one gives an empty result. Other columns are left out, whatever their names. A task holds a
    batch of texts at a time, however long they are.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    n_blocks = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(key.alias("key"), F.xxhash64("text").alias("sub"), "doc_id", "text")
    block_of = _blocks(keyed, n_blocks)
    kind = dict(docs.dtypes)["doc_id"]

    def last_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, tuple[int, int]] = {}
        for batch in batches:
            keys, subs = batch.column("key").to_numpy(), batch.column("sub").to_numpy()
            blocks = block_of(keys, subs)
            order = np.lexsort((subs, keys, blocks))
            ends = np.flatnonzero(np.append(np.diff(blocks[order]) != 0, True)) if len(order) else []
            for i in order[ends] if len(order) else []:
                place = int(keys[i]), int(subs[i])
                most[int(blocks[i])] = max(most.get(int(blocks[i]), place), place)
        found = most.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(most), pa.int32()), pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64())],
            ["block", "key", "sub"],
        )

    last = (
        keyed.select("key", "sub").mapInArrow(last_ids, "block int, key bigint, sub bigint")
        .groupBy("block").agg(F.max(F.struct("key", "sub")).alias("last")).orderBy("block").collect()  # a row for each block
    )
    wanted: dict[tuple[int, int], list[int]] = {}
    for i, row in enumerate(last):
        wanted.setdefault(tuple(last[i - 1]["last"]), []).append(row["block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, subs = batch.column("key").to_numpy(), batch.column("sub").to_numpy()
            extra = [(i, b) for i, k in enumerate(zip(keys.tolist(), subs.tolist(), strict=True)) for b in wanted.get(k, ())]
            take = pa.array([*range(len(keys)), *(i for i, _ in extra)], pa.int32())
            blocks = [*block_of(keys, subs).tolist(), *(b for _, b in extra)]
            signed = pa.array([signature(t).tobytes() for t in texts_of(batch)], pa.binary())
            columns = [
                pa.array(blocks, pa.int32()), pa.array([True] * len(keys) + [False] * len(extra)),
                batch.column("key").take(take), batch.column("sub").take(take), batch.column("doc_id").take(take),
                batch.column("text").take(take), signed.take(take),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "own", "key", "sub", "doc_id", "text", "signed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, signed = "", None
        for batch in batches:
            ids, rows = [], []
            owns, texts = batch.column("own").to_pylist(), batch.column("text").to_pylist()
            for i, (own, now, sign) in enumerate(zip(owns, texts, batch.column("signed").to_pylist(), strict=True)):
                now, sign = now or "", np.frombuffer(sign, "<u2")
                if own:
                    cut = len(now) // 3
                    edited = (now[: len(now) - cut] + text[:cut]).encode()
                    other = signature(edited)
                    ids.append(i)
                    rows.append((
                        len(now), hashlib.sha256(edited).hexdigest(), sign.tobytes().hex(), other.tobytes().hex(),
                        likeness(sign, other), likeness(sign, signed),
                    ))
                text, signed = now, sign
            if not rows:
                continue
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = [field.split()[0] for field in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), *columns], ["doc_id", *names])

    dealt = keyed.mapInArrow(
        deal, f"block int, own boolean, key bigint, sub bigint, doc_id {kind}, text string, signed binary"
    )
    return (
        dealt.repartition(F.col("block"))
        .sortWithinPartitions("block", "own", "key", "sub", "text")
        .mapInArrow(compare, f"doc_id {kind}, {RESULT}")
    )


def _blocks(keyed: DataFrame, n_blocks: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Block of each (key, sub) by ranges of about equal numbers of rows."""
    shares = [i / n_blocks for i in range(1, n_blocks)]
    ranges = F.percentile_approx
    found = keyed.agg(ranges("key", shares, BOUND_ERROR * n_blocks)).first()[0] or []
    # a key that holds more than a block's share is met more than once
    keys, times = np.unique(np.array(found, np.int64), return_counts=True)
    hot = {int(k): int(n) for k, n in zip(keys, times, strict=True) if n > 1}
    cuts: dict[int, np.ndarray] = {}
    if hot:
        inside = keyed.where(F.col("key").isin(list(hot))).groupBy("key")  # fewer keys than blocks
        for row in inside.agg(ranges("sub", shares, BOUND_ERROR * n_blocks).alias("subs")).collect():
            steps = np.linspace(0, len(row["subs"]) - 1, hot[row["key"]]).astype(int)
            cuts[row["key"]] = np.unique(np.array(row["subs"], np.int64)[steps])
    starts = np.concatenate([[0], np.cumsum([1 + len(cuts.get(int(k), ())) for k in keys])]).astype(np.int64)

    def block_of(key: np.ndarray, sub: np.ndarray) -> np.ndarray:
        place = np.searchsorted(keys, key, side="right")
        blocks = starts[place]
        for k, subs in cuts.items():
            own = key == k
            first = starts[np.searchsorted(keys, k)] + 1
            blocks[own] = first + np.searchsorted(subs, sub[own], side="right")
        return blocks.astype(np.int32)

    return block_of
