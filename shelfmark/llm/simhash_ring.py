"""SimHash near-dedup with a pigeonring filter.

A fingerprint has four segments in a ring. If two fingerprints differ in at most d bits, then from
some segment on every chain of l segments differs in at most l * d / 4 bits. For three bits that is:
an equal segment, at most one bit in the next, two bits in the first three. The first two conditions
are a join key; the others prune what it finds before the full comparison.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map, free_name, texts_of
from shelfmark.operators.joins import MAX_BROADCAST_BYTES
from shelfmark.session import staged, staged_with_counts

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 4
WIDTH = 16
# Keys with more members are compared block by block, and give spanning trees in place of pairs.
HOT_MEMBERS = 512
KEY_BYTES = 32
# Shingles counted at a time.
BLOCK = 65_536


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is set in over half of the hashes of the word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    width = min(shingle_words, len(words))
    places = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in places), np.uint64, len(words) - width + 1)
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) for each document, fp as a signed 64-bit number; null texts count as empty."""
    kind = dict(docs.dtypes)["doc_id"]
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return arrow_map(hashed, hashed.columns, f"doc_id {kind}, text_hash bigint, fp bigint", lambda batch: {
        "doc_id": batch.column("doc_id"),
        "text_hash": batch.column("text_hash"),
        "fp": pa.array(np.array([fingerprint(t, shingle_words) for t in texts_of(batch)], np.uint64).view(np.int64)),
    })


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b), a > b, between distinct fingerprints of column fp, that connect just those
    which links of at most ``distance`` bits, three or fewer, connect. All links are given but inside
    hot keys, where spanning trees stand for them."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the ring's keys find fingerprints up to {DISTANCE} bits apart")
    fp = F.col("fp")
    exact = nodes.select(
        "fp", F.explode(F.array(*[_ring_key(i) for i in range(SEGMENTS)])).alias("key")
    )
    # one of two fingerprints that differ in one bit of the second segment has it set: with it
    # cleared, its key is the other's
    cleared = [
        F.when(F.getbit(fp, F.lit(_shift(i + 1) + bit)) == 1, _ring_key(i) - (1 << bit))
        for i in range(SEGMENTS) for bit in range(WIDTH)
    ]
    near = nodes.select("fp", F.explode(F.array_compact(F.array(*cleared))).alias("key"))
    sizes, counts = staged_with_counts(
        exact.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > HOT_MEMBERS),
        "ring-hot", F.count(F.lit(1)).alias("n"),
    )
    either = exact.withColumn("near", F.lit(False)).unionByName(near.withColumn("near", F.lit(True)))
    if counts["n"]:
        hot = F.broadcast(sizes) if counts["n"] * KEY_BYTES <= MAX_BROADCAST_BYTES else sizes
        edges = _hot_edges(either.join(hot, "key"), distance)
        either = either.join(hot.select("key"), "key", "left_anti")
    build = exact.select("key", F.col("fp").alias("other"))
    pairs = either.join(build, "key").where((F.col("fp") != F.col("other")) & (F.col("near") | (F.col("fp") > F.col("other"))))
    differ = fp.bitwiseXOR(F.col("other"))
    start = F.shiftright("key", 2 * WIDTH).cast("int")
    third = F.element_at(F.array(*[_segment(differ, i + 2) for i in range(SEGMENTS)]), start + 1)
    second = F.element_at(F.array(*[_segment(differ, i + 1) for i in range(SEGMENTS)]), start + 1)
    chained = F.bit_count(second) + F.bit_count(third) <= 3 * distance // SEGMENTS
    found = pairs.where(chained & (F.bit_count(differ) <= distance)).select(
        F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")
    )
    return (found.unionByName(edges) if counts["n"] else found).distinct()


def _shift(segment: int) -> int:
    return 64 - WIDTH * (segment % SEGMENTS + 1)


def _segment(bits: Column, segment: int) -> Column:
    return F.shiftrightunsigned(bits, _shift(segment)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("bigint"))


def _ring_key(start: int) -> Column:
    """Two consecutive segments, and which they are."""
    fp = F.col("fp")
    return F.lit(start << 2 * WIDTH).cast("bigint") + _segment(fp, start) * (1 << WIDTH) + _segment(fp, start + 1)


def _dealt(members: DataFrame) -> DataFrame:
    """(key, one, two, fp): members of hot keys in groups to compare. Rows with the key itself and rows
    near it are dealt into blocks each; a group is two blocks, one at least with the key itself, so both
    its sides are bounded however many rows lie near a key."""
    counts = staged(members.groupBy("key").agg(
        F.ceil(F.count_if(~F.col("near")) / HOT_MEMBERS).cast("int").alias("blocks"),
        F.ceil(F.count_if("near") / HOT_MEMBERS).cast("int").alias("near_blocks"),
    ), "ring-blocks")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("near"), F.col("near_blocks")).otherwise(F.col("blocks"))).cast("int")
    # near blocks have numbers below zero; with one of them goes each block of the key itself
    own = F.when(F.col("near"), -1 - own).otherwise(own)
    lowest = F.when(F.col("near"), F.lit(0)).otherwise(-F.col("near_blocks"))
    dealt = members.join(counts, "key").select(
        "key", "fp", own.alias("own"), F.explode(F.sequence(lowest, F.col("blocks") - 1)).alias("with")
    )
    return dealt.select("key", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "fp")


def _hot_edges(members: DataFrame, distance: int) -> DataFrame:
    """Edges among the members of hot keys, a spanning tree for each group."""

    def trees(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(frame["fp"].to_numpy(np.int64).view(np.uint64))
        open_, edges = np.ones(len(values), bool), []
        for seed in range(len(values)):
            if not open_[seed]:
                continue
            open_[seed], queue = False, [seed]
            while queue:
                node = queue.pop()
                reached = np.flatnonzero(open_ & (np.bitwise_count(values ^ values[node]) <= distance))
                open_[reached] = False
                queue += reached.tolist()
                edges += [(node, i) for i in reached.tolist()]
        pairs = values.view(np.int64)[np.array(edges, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": pairs.max(axis=1), "b": pairs.min(axis=1)})

    return _dealt(members).groupBy("key", "one", "two").applyInPandas(trees, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of each component. Alternates stars at the larger and
    at the smaller neighbours until nothing changes; each round is stored."""
    marks = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("mark"))
    edges, before = staged_with_counts(edges.select("a", "b"), "star", *marks)
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = staged(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct(), "star",
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        edges, now = staged_with_counts(small, "star", *marks)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each document, repeated rows included.

    Documents with equal fingerprints, or fingerprints at most ``distance`` bits apart, are linked;
    component_id is the least doc_id that links reach. Texts without words have fingerprint zero and
    are linked like others. Rows without doc_id take part; a group without any doc_id has a null
    component_id. Copies share one fingerprint and make no pairs. Long texts are counted in blocks of
    shingles; an empty table gives an empty result; other columns are left out, whatever their names.
    """
    prints = staged(fingerprints(docs, shingle_words), "ring-prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "ring-nodes")
    roots = components(fingerprint_links(nodes.select("fp"), distance))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = staged(linked.join(least, "root").select("fp", "component_id"), "ring-groups")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The documents, one of each near-duplicate group: that of the least doc_id; of rows that repeat
    this doc_id and text one stays. Of a group without any doc_id each different text stays.
    ``groups`` (doc_id, text_hash, component_id) are those of near_groups unless given."""
    key, mark = free_name(docs, "ring_id"), free_name(docs, "ring_text")
    groups = near_groups(docs) if groups is None else groups
    chosen = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(mark)
    )
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(mark))
    return docs.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "text"])


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
