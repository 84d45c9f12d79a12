"""Shards by a k-d tree over document metadata.

A node is cut along its widest dimension at the weighted median of its documents (the weight is
their size in bytes), until each leaf has about the target bytes. Rows never move to find a cut:
each pass sums weights in buckets between the bounds still open, per task first, and only the
bucket that holds the cut is opened further.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import staged

# Buckets between the bounds of one pass.
BUCKETS = 1024
# Cells in which rows are numbered, over all shards; the table of cell starts is bounded by it.
CELLS = 65_536
# A cut this near to its mark, as a share of the target bytes, is not refined.
TOLERANCE = 0.0005
# Most leaves: the cuts of one level, one row each, are held by the driver and broadcast.
MAX_LEAVES = 200_000
NO_ID = -(2**63)


@dataclass
class _Node:
    """An open cut: documents up to (k0, k1, k2) go left, where their bytes reach the mark."""

    left: int
    right: int
    dim: int
    mark: float
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    before: float = 0.0
    phase: int = 0
    cut: tuple | None = None


def kd_shards(
    docs: DataFrame, dimensions: Mapping[str, Column], target_bytes: int | None = None, shards: int | None = None
) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, shard, slot), by bytes.

    size is the UTF-8 bytes of the text plus 1; null texts have none. ``dimensions`` are numeric
    expressions over the columns of the documents (nulls count as 0). Give the bytes of a leaf, or
    the number of leaves. Documents with equal values on the cut dimension are ordered by a hash of
    their text and then by doc_id, so equal texts part only where a cut falls inside their group;
    rows equal in all of these stay together. slot counts from 0 without gaps in each shard, in an
    order that depends on the data alone. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"d{i}" for i in range(len(dimensions))]
    rows = staged(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).cast("bigint").alias("text_crc32"),
            # half the range, so that differences do not overflow
            F.shiftright(F.xxhash64(text), 1).alias("k1"),
            F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k2"),
            *[
                F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(name)
                for name, column in zip(names, dimensions.values(), strict=True)
            ],
        ),
        "kd-meta",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    leaves = shards or max(1, math.ceil(total / target_bytes))
    if leaves > MAX_LEAVES:
        raise ValueError(f"{leaves} leaves; at most {MAX_LEAVES} are allowed")
    placed = _place(rows, names, leaves, total / leaves)
    return _with_slots(placed, leaves)


def _place(rows: DataFrame, names: list[str], leaves: int, target: float) -> DataFrame:
    """Adds shard: nodes are named by the first of their leaves, 0 being the root."""
    placed = rows.withColumn("shard", F.lit(0))
    open_nodes = {0: leaves}
    spans: dict[str, float] = {}
    while any(n > 1 for n in open_nodes.values()):
        facts = placed.groupBy("shard").agg(
            F.sum("size").alias("bytes"),
            *[f(name).alias(f"{kind}_{name}") for name in names for kind, f in (("min", F.min), ("max", F.max))],
        )
        nodes: dict[int, _Node] = {}
        children: dict[int, int] = {}
        for row in facts.collect():  # one row for each node, bounded by the leaves
            n = open_nodes[row["shard"]]
            ranges = [row[f"max_{d}"] - row[f"min_{d}"] for d in names]
            spans = spans or dict(zip(names, ranges, strict=True))
            if n == 1:
                children[row["shard"]] = 1
                continue
            shares = [r / spans[d] if spans[d] > 0 else 0.0 for d, r in zip(names, ranges, strict=True)]
            dim = max(range(len(names)), key=lambda i: shares[i])
            left = n // 2
            nodes[row["shard"]] = _Node(
                row["shard"], row["shard"] + left, dim, row["bytes"] * left / n,
                low=[row[f"min_{names[dim]}"]], high=[row[f"max_{names[dim]}"]],
            )
            children |= {row["shard"]: left, row["shard"] + left: n - left}
        if not nodes:
            return placed
        _find_cuts(placed, names, nodes, TOLERANCE * target)
        cuts = [(s, n.right, n.dim, *n.cut) for s, n in nodes.items()]
        cut = placed.sparkSession.createDataFrame(
            cuts, "shard int, right int, dim int, c0 double, c1 bigint, c2 bigint"
        )
        beyond = F.struct(_chosen(names), "k1", "k2") > F.struct("c0", "c1", "c2")
        moved = placed.join(F.broadcast(cut), "shard", "left").withColumn(
            "shard", F.when(F.col("right").isNotNull() & beyond, F.col("right")).otherwise(F.col("shard"))
        )
        placed = staged(moved.select(*placed.columns), "kd-level")
        open_nodes = children
    return placed


def _chosen(names: list[str]) -> Column:
    """The value on the dimension of the row's node."""
    return F.element_at(F.array(*[F.col(n) for n in names]), F.col("dim") + 1)


def _find_cuts(placed: DataFrame, names: list[str], nodes: dict[int, _Node], tolerance: float) -> None:
    """Sets the cut of each node: first its value, among equal values its text hash, then its id."""
    spark = placed.sparkSession
    largest = 2**63 - 1
    while any(n.cut is None for n in nodes.values()):
        phase = min(n.phase for n in nodes.values() if n.cut is None)
        asked = [
            (s, n.dim, n.mark - n.before, *(n.low[:phase] + [0] * 2)[:2], n.low[phase], n.high[phase])
            for s, n in nodes.items()
            if n.cut is None and n.phase == phase
        ]
        kind = "double" if phase == 0 else "bigint"
        bounds = spark.createDataFrame(
            [(s, d, m, float(v0), int(v1), lo, hi) for s, d, m, v0, v1, lo, hi in asked],
            f"shard int, dim int, mark double, v0 double, v1 bigint, lo {kind}, hi {kind}",
        )
        rows = placed.join(F.broadcast(bounds), "shard")
        key = [_chosen(names), F.col("k1"), F.col("k2")][phase]
        same = F.lit(True)
        for i in range(phase):
            same = same & ([_chosen(names), F.col("k1")][i] == F.col(f"v{i}"))
        wide = "double" if phase == 0 else "decimal(20,0)"
        rise = (key.cast(wide) - F.col("lo").cast(wide)).cast("double")
        span = (F.col("hi").cast(wide) - F.col("lo").cast(wide)).cast("double")
        share = F.when(span > 0, rise / span).otherwise(F.lit(0.0))
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        sums = (
            rows.where(same & key.between(F.col("lo"), F.col("hi")))
            .groupBy("shard", bucket.alias("bucket"))
            .agg(F.sum("size").alias("w"), F.min(key).alias("mn"), F.max(key).alias("mx"), F.max("mark").alias("mark"))
        )
        upto = Window.partitionBy("shard").orderBy("bucket")  # at most BUCKETS rows
        found = (
            sums.withColumn("upto", F.sum("w").over(upto))
            .where(F.col("upto") >= F.col("mark"))
            .withColumn("rank", F.row_number().over(upto))
            .where("rank = 1")
            .collect()  # one row for each node
        )
        for row in found:
            node = nodes[row["shard"]]
            node.before += row["upto"] - row["w"]
            node.low[phase], node.high[phase] = row["mn"], row["mx"]
            fits = abs(node.before + row["w"] - node.mark) <= tolerance
            if fits or (phase == 2 and row["mn"] == row["mx"]):
                node.cut = tuple([*node.low[:phase], row["mx"], largest, largest][:3])
            elif row["mn"] == row["mx"]:
                node.phase += 1
                node.low.append(0 if phase == 0 else NO_ID)
                node.high.append(largest)
                if phase == 0:
                    node.low[1] = NO_ID // 2
        missing = [s for s, *_ in asked if s not in {r["shard"] for r in found}]
        for s in missing:  # rounding of the mark: everything that is open goes left
            node = nodes[s]
            node.cut = tuple([*node.low[:phase], node.high[phase], largest, largest][:3])


def _with_slots(placed: DataFrame, shards: int) -> DataFrame:
    """Numbers the rows of each shard: by cell of a hash, then by rank inside the cell."""
    cells = max(1, CELLS // shards)
    celled = placed.withColumn("cell", F.pmod(F.xxhash64("k2", "k1"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        celled.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("k2", "k1"))
    return (
        celled.withColumn("rank", rank)
        .join(F.broadcast(starts), ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", "shard",
            (F.col("start") + F.col("rank") - 1).cast("bigint").alias("slot"),
        )
    )
