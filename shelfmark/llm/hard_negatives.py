"""Hard negatives by the threshold algorithm.

Vectors are scaled to integers, so scores are exact. Anchors, a stated set of queries, meet all rows in
cells: a bounded number of anchors against a bounded number of rows. In a cell the rows are listed in the
order of each component. For an anchor the lists are read in step, from the large end where the anchor's
component is positive and from the small end where it is negative; every row met is scored in full. The
threshold, what a row could score at most that no list has shown yet, sinks with each step, and the search
ends once it lies strictly below the k-th score of every window (below the window itself as long as that
holds fewer). Spark merges the cells' results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.joins import lookup_join
from shelfmark.session import staged, staged_with_counts

SCALE = 256
# Rows and anchors of a cell, about.
CELL_ROWS, CELL_ANCHORS = 4096, 2048
# Parts of a list read in one step.
STEPS = 16
_EXACT_FLOAT, _EXACT_LONG = 2.0**53, 2.0**63


class Lists:
    """Rows of a cell in the order of each component."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.rising = np.argsort(vectors, axis=0, kind="stable")
        self.falling = self.rising[::-1]
        self.scored = 0

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: Sequence[tuple[float, float]], k: int) -> list:
        """For each window (low, high) the places and scores of the first k allowed rows with a score in it:
        higher scores first, ties by smaller id."""
        count = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) + len(down):
            up = np.array([0])  # all scores are zero; any list shows all rows
        seen, scores = np.zeros(count, bool), np.zeros(count, self.vectors.dtype)
        step, depth = max(1, -(-count // STEPS)), 0
        least_high = min(high for _, high in windows)
        while depth < count:
            met = np.zeros(count, bool)
            met[self.falling[depth : depth + step, up].ravel()] = True
            met[self.rising[depth : depth + step, down].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
            seen[fresh] = True
            scores[fresh] = self.vectors[fresh] @ anchor
            depth = min(depth + step, count)
            threshold = (
                self.vectors[self.falling[depth - 1, up], up] @ anchor[up]
                + self.vectors[self.rising[depth - 1, down], down] @ anchor[down]
            )
            # a k-th score is no higher than its window
            if threshold < least_high and all(
                threshold < self._kth(scores[seen & allowed], low, high, k) for low, high in windows
            ):
                break
        self.scored += int(seen.sum())
        open_ = seen & allowed
        return [self._first(np.flatnonzero(open_ & (scores >= low) & (scores <= high)), scores, k) for low, high in windows]

    @staticmethod
    def _kth(scores: np.ndarray, low: float, high: float, k: int) -> float:
        inside = scores[(scores >= low) & (scores <= high)]
        return np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else low

    def _first(self, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = places[np.lexsort((self.ids[places], -scores[places]))[:k]]
        return best, scores[best].astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; missing components at the end are zero."""
    lists = pa.concat_arrays(column.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    found = np.zeros((len(lists), width), np.int64)
    found[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return found


def _cell(rows: pa.Table, anchors: pa.Table) -> tuple[Lists, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of the rows, labels of the rows, vectors and labels of the anchors. Scores are exact: as doubles
    where they fit, else as 64-bit integers, or refused."""
    width = max(max((len(x) for x in t.column("v")), default=0) for t in (rows, anchors))
    many, few = _matrix(rows.column("v"), max(1, width)), _matrix(anchors.column("v"), max(1, width))
    most = float(np.abs(many.astype(float)).max()) * float(np.abs(few.astype(float)).sum(axis=1).max())
    if most >= _EXACT_LONG:
        raise ValueError("scores leave the range of 64-bit integers")
    kind = np.float64 if most < _EXACT_FLOAT else np.int64
    lists = Lists(many.astype(kind), rows.column("vec_id").to_numpy())
    return lists, rows.column("label").to_numpy(), few.astype(kind), anchors.column("label").to_numpy()


def _table(schema: pa.Schema, parts: list[tuple]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * len(schema)
    return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in columns], schema)


def _longs(*names: str) -> tuple[pa.Schema, str]:
    return pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} bigint" for n in names)


def integer_vectors(vectors: DataFrame, anchors: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v, anchor) of the rows that take part, each vec_id once."""
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    one = rows.where(~odd).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.struct(F.col("label").cast("bigint").alias("label"), whole.alias("v")).alias("row"),
    )
    return one.groupBy("vec_id").agg(F.max("anchor").alias("anchor"), F.min("row").alias("row")).select(
        "vec_id", "row.label", "row.v", "anchor"
    )


def _dealt(rows: DataFrame, anchors: DataFrame, packs: Column, salts: Column):
    """Groups of rows and of anchors by cell: each row goes to every pack of anchors, each anchor to every
    salt of rows. Sizes are even, because ids are hashed."""
    own = F.xxhash64("vec_id")
    keys = ["label", "pack", "salt"] if "packs" in rows.columns else ["pack", "salt"]
    left = rows.withColumn("salt", F.pmod(own, salts)).withColumn("pack", F.explode(F.sequence(F.lit(0), packs - 1)))
    right = anchors.withColumn("pack", F.pmod(own, packs)).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    lists = [c for c in right.columns if c.startswith("positive")]

    def grouped(side: DataFrame, more: list[str]):
        # new names for each side: both come from one table
        plain = side.select(*(F.col(c).cast("bigint").alias(c) for c in ("pack", "salt", "vec_id", "label")), *(F.col(c).alias(c) for c in ["v", *more]))
        return plain.groupBy(*keys)

    return grouped(left, []).cogroup(grouped(right, lists))


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the first k other rows of each anchor's label."""
    cells = staged(rows.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("salts"),
        F.ceil(F.count_if("anchor") / CELL_ANCHORS).cast("int").alias("packs"),
    ).where("packs > 0"), "mine-cells")
    schema, kinds = _longs("anchor_id", "positive_id", "positive_score")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            lists, _, vectors, _ = _cell(left, right)
            for anchor, vector in zip(right.column("vec_id").to_pylist(), vectors, strict=True):
                [(best, scores)] = lists.search(vector, lists.ids != anchor, [(-np.inf, np.inf)], k)
                parts.append((np.full(len(best), anchor), lists.ids[best], scores))
        return _table(schema, parts)

    sized = lookup_join(rows, cells, ["label"])
    found = _dealt(sized, sized.where("anchor"), F.col("packs"), F.col("salts")).applyInArrow(search, kinds)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def mine(
    vectors: DataFrame, anchors: Column, positives: int, negatives: int, least_percent: int, most_percent: int
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` of vec_id,
    vector and label (integers).

    A score is the integer product of an anchor with a row; higher scores come first, ties by smaller
    vec_id. An anchor's positives are its first rows of the same label but itself. For each of them the first
    rows of other labels are given whose score is from least_percent to most_percent of the positive's; rank
    counts from 1. Rows with a null in vec_id, label, vector or a component, or a component that is not
    finite, take no part. Rows of one vec_id count once: the least label, then the least vector. Shorter
    vectors count as filled up with zeros. An empty table, or one without anchors, gives an empty result;
    other columns are left out, whatever their names. Scores beyond 64 bits are refused with an error.
    """
    rows, counts = staged_with_counts(
        integer_vectors(vectors, anchors), "mine-rows",
        F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"),
    )
    nearest = staged(_nearest(rows, positives), "mine-positives")
    held = nearest.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list("positive_id").alias("positive_ids"), F.collect_list("positive_score").alias("positive_scores")
    )
    queries = rows.where("anchor").drop("anchor").join(held, "vec_id")
    schema, kinds = _longs("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            lists, labels, vectors, own = _cell(left, right)
            for i, row in enumerate(right.select(["vec_id", "positive_ids", "positive_scores"]).to_pylist()):
                spans = {
                    (who, score): (-(-least_percent * score // 100), most_percent * score // 100)
                    for who, score in zip(row["positive_ids"], row["positive_scores"], strict=True)
                }
                spans = {held: (low, high) for held, (low, high) in spans.items() if low <= high}
                if not spans:
                    continue
                found = lists.search(vectors[i], labels != own[i], list(spans.values()), negatives)
                for (who, score), (best, scores) in zip(spans, found, strict=True):
                    same = (np.full(len(best), x) for x in (row["vec_id"], who, score))
                    parts.append((*same, lists.ids[best], scores))
        return _table(schema, parts)

    packs = F.lit(max(1, -(-counts["anchors"] // CELL_ANCHORS)))
    salts = F.lit(max(1, -(-counts["rows"] // CELL_ROWS)))
    found = _dealt(rows.drop("anchor"), queries, packs, salts).applyInArrow(search, kinds)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
