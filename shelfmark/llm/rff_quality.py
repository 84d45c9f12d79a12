"""Quality scores from random Fourier features.

Statistics of each text are mapped through random cosines that approximate a Gaussian kernel. Ridge
regression on them needs only sums over rows, which each task adds up for its own rows; the sums,
whose size does not depend on the number of documents, are solved by the driver. The raw scores
become chances by isotonic regression.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map, texts_of
from shelfmark.session import staged

FEATURES = 192
RIDGE = 1e-3
# Cells of raw scores that are calibrated as one.
CELLS = 2000
LOWEST, HIGHEST = -0.5, 1.5
# Labelled rows summed by one task.
ROWS_PER_TASK = 20_000
# Classes of bytes whose shares are statistics.
_CLASSES = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "#*$%&", "|<>",
    "\n", " \t\r", "()[]{}\"'/-_=+@", None,
)
STATISTICS = 8 + len(_CLASSES)


def _class_table() -> np.ndarray:
    found = np.full(256, len(_CLASSES), np.uint8)
    for i, chars in enumerate(_CLASSES):
        if chars is None:
            found[128:] = i
        else:
            found[np.frombuffer(chars.encode(), np.uint8)] = i
    return found


_TABLE = _class_table()


def statistics(text: bytes) -> np.ndarray:
    """Facts of one text, all of moderate size; an empty text has zeros."""
    words, lines = text.split(), text.split(b"\n")
    n, n_words = max(len(text), 1), max(len(words), 1)
    shares = np.bincount(_TABLE[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 1)[:-1] / n
    width = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    pairs = len(set(itertools.pairwise(words)))
    return np.concatenate([
        [
            np.log1p(len(text)), np.log1p(len(words)), width.mean() / 10, width.std() / 10,
            distinct / n_words, pairs / n_words, len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
        ],
        np.sqrt(shares),
    ])


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each document; null texts count as empty."""
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs, ["doc_id", "text"], f"doc_id {kind}, stats array<double>", lambda batch: {
        "doc_id": batch.column("doc_id"),
        "stats": pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64())),
    })


class Kernel:
    """Standardised statistics, and random cosines of them, with a column of ones."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = 7):
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        rng = np.random.default_rng(seed)
        width = np.sqrt(len(mean))  # the distance of two typical rows
        self.frequencies = rng.normal(size=(len(mean), features)) / width
        self.phases = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.deviation, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.frequencies + self.phases)
        return np.hstack([waves, np.ones((len(stats), 1))])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: 1 is held out, 0 and 2 are the two folds of learning."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3).cast("int")


def normal_equations(rows: DataFrame, kernel: Kernel) -> dict[int, np.ndarray]:
    """For each fold the matrix of sums [Z y]' [Z y]; rows: (fold, stats, label)."""
    size = len(kernel.phases) + 2

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby("fold"):
                z = np.hstack([kernel(np.stack(part["stats"])), part[["label"]].to_numpy(np.float64)])
                sums[key] = sums.get(key, 0) + z.T @ z
        for key, matrix in sums.items():
            yield pd.DataFrame({"fold": key, "row": range(size), "sums": list(matrix)})

    cells = rows.mapInPandas(partial, "fold int, row int, sums array<double>").select(
        "fold", "row", F.posexplode("sums").alias("col", "value")
    )
    # a row for each cell of the matrices, whatever the number of documents
    total = cells.groupBy("fold", "row", "col").agg(F.sum("value").alias("value")).collect()
    matrices: dict[int, np.ndarray] = {}
    for row in total:
        matrices.setdefault(row["fold"], np.zeros((size, size)))[row["row"], row["col"]] = row["value"]
    return matrices


def solve(matrix: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    gram, right = matrix[:-1, :-1], matrix[:-1, -1]
    penalty = ridge * max(gram[-1, -1], 1) * np.eye(len(gram)) / len(gram)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, right)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the rising function nearest to the points: mean place and height of each pool."""
    pools: list[list[float]] = []
    for place, height, w in sorted(zip(x.tolist(), y.tolist(), weight.tolist(), strict=True)):
        pools.append([place * w, height * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    found = np.array(pools)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


class Scorer:
    """Raw scores by ridge, chances by linear interpolation between the corners of the calibration."""

    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, corners: tuple, base: float):
        self.kernel, self.weights, self.corners, self.base = kernel, weights, corners, base

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), self.base)
        raw = np.clip(self.kernel(stats) @ self.weights, LOWEST, HIGHEST)
        chance = np.interp(raw, *self.corners)
        # plateaus keep the order of the raw scores
        return 0.998 * chance + 0.002 * (raw - LOWEST) / (HIGHEST - LOWEST)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Scorer:
    """Learn from the labelled rows that are not held out; stats: (doc_id, stats), labels: (doc_id, label).

    Two models, each learnt from one fold, score the other fold for the calibration, and the final
    one uses both: sums of folds add. Null labels and ids are left out; of repeated labels of an id
    each counts. Without rows of both classes every score is their share of ones, or 0.5.
    """
    facts = stats.agg(
        *[f(F.col("stats")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]
    ).first()
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("double").alias("label"), fold(F.col("doc_id")).alias("fold")
    )
    known = staged(stats.join(known.where("fold <> 1"), "doc_id").select("fold", "stats", "label"), "quality-known")
    n_rows, base, classes = known.agg(
        F.count(F.lit(1)), F.avg("label"), F.count_distinct("label")
    ).first()
    if classes < 2:
        return Scorer(None, None, (), 0.5 if base is None else base)
    moments = np.array(facts, np.float64).reshape(STATISTICS, 2)
    kernel = Kernel(moments[:, 0], moments[:, 1])
    dealt = known.repartition(1 + n_rows // ROWS_PER_TASK)
    sums = normal_equations(dealt, kernel)
    weights = {key: solve(matrix) for key, matrix in sums.items()}

    def raw_scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, part in frame.groupby("fold"):
                used = weights.get(2 - key, weights[key])
                raw = np.clip(kernel(np.stack(part["stats"])) @ used, LOWEST, HIGHEST)
                cell = np.minimum((raw - LOWEST) / (HIGHEST - LOWEST) * CELLS, CELLS - 1).astype(int)
                yield pd.DataFrame({"cell": cell, "label": part["label"].to_numpy()})

    cells: list[Row] = (
        dealt.mapInPandas(raw_scores, "cell int, label double")
        .groupBy("cell").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n"))
        .collect()  # at most CELLS rows
    )
    x = LOWEST + (np.array([r["cell"] for r in cells]) + 0.5) * (HIGHEST - LOWEST) / CELLS
    corners = isotonic(x, np.array([r["y"] for r in cells]), np.array([r["n"] for r in cells], float))
    return Scorer(kernel, solve(sum(sums.values())), corners, base)


def score(stats: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of statistics."""
    kind = dict(stats.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> dict:
        rows = np.array(batch.column("stats").to_pylist(), np.float64)
        return {"doc_id": batch.column("doc_id"), "score": pa.array(scorer(rows), pa.float64())}

    scored = arrow_map(stats, ["doc_id", "stats"], f"doc_id {kind}, score double", run)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, repeated rows included.

    Scores are chances of label 1, from the whole text alone; null texts count as empty. Without
    usable labels see ``fit``; without documents there are no rows.
    """
    stats = staged(text_statistics(docs), "quality-stats")
    return score(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is at least ``least``.

    Scores are as in ``quality``, of the whole corpus given. Texts do not move: once the scorer is
    learnt, each task scores the rows it reads.
    """
    scorer = fit(staged(text_statistics(docs), "quality-stats"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = scorer(np.array([statistics(t) for t in texts_of(batch)])) >= least
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
