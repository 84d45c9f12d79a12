"""Quality rules with an isolation forest.

Counts of each text feed fixed rules and, as ratios, a forest of random splits. Documents that few
splits set apart have short paths and are odd; from which shortness on a document goes is
calibrated on labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map, texts_of
from shelfmark.session import staged

MIN_WORDS = 50
# Labelled rows, those of least id hash, from which the forest is made: a documented bound.
SAMPLE_ROWS = 16_384
TREES = 128
TREE_ROWS = 1024
DEPTH = 10
# Cells of odd scores, and the share of good rows that the threshold has to keep.
CELLS = 1000
KEEP_GOOD = 0.999
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = bytes(b"#*$%&|<>")


def counts(text: bytes) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated_lines += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    return len(words), chars, symbols, repeated_lines, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, often = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    repeated = often[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(repeated)] |= repeated
    return int(covered.sum())


def rule_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each
    document; a null text has no words."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([counts(t) for t in texts_of(batch)], np.int64).reshape(-1, len(COUNTS))
        return {"doc_id": batch.column("doc_id")} | {c: pa.array(found[:, i]) for i, c in enumerate(COUNTS)}

    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return arrow_map(docs, ["doc_id", "text"], schema, run).withColumn("base_failed", failed)


def ratios(rows: np.ndarray) -> np.ndarray:
    """What the forest splits on, from rows of COUNTS; length itself is left to the base rule."""
    words = np.maximum(rows[:, 0], 1).astype(float)
    return np.column_stack([
        rows[:, 1] / words, np.sqrt(rows[:, 2] / words), np.sqrt(rows[:, 3]), np.sqrt(rows[:, 4] / words),
    ])


def _path_of(n: float) -> float:
    """Mean path length in a search tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class Forest:
    """Trees as arrays: node i has children 2i + 1 and 2i + 2; leaves hold their path length.

    The rows of ``sample`` are set apart by splits anywhere between ``low`` and ``high``, also
    outside the sample's own range: rows out there are then alone after few splits.
    """

    def __init__(
        self, sample: np.ndarray, low: np.ndarray, high: np.ndarray,
        trees: int = TREES, rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 11,
    ):
        rng = np.random.default_rng(seed)
        size = 2 ** (depth + 1) - 1
        self.depth, self.scale = depth, max(_path_of(min(rows, len(sample))), 1.0)
        self.dim = np.zeros((trees, size), np.int64)
        self.cut = np.full((trees, size), np.inf)
        self.path = np.zeros((trees, size))
        for tree in range(trees):
            chosen = sample[rng.choice(len(sample), min(rows, len(sample)), replace=False)]
            stack = [(0, chosen, 0, low, high)]
            while stack:
                node, part, level, begin, end = stack.pop()
                self.path[tree, node] = level + _path_of(len(part))
                if level == depth or len(part) < 2 or not (end > begin).any():
                    continue
                dim = rng.choice(np.flatnonzero(end > begin))
                cut = rng.uniform(begin[dim], end[dim])
                self.dim[tree, node], self.cut[tree, node] = dim, cut
                left = part[:, dim] < cut
                left_end, right_begin = end.copy(), begin.copy()
                left_end[dim] = right_begin[dim] = cut
                stack.append((2 * node + 1, part[left], level + 1, begin, left_end))
                stack.append((2 * node + 2, part[~left], level + 1, right_begin, end))

    def odd(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for tree in range(len(self.dim)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                cut = self.cut[tree, node]
                inner = np.isfinite(cut)
                if not inner.any():
                    break
                right = rows[every, self.dim[tree, node]] >= cut
                node = np.where(inner, 2 * node + 1 + right, node)
            total += self.path[tree, node]
        return 2.0 ** (-total / len(self.dim) / self.scale)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[Forest | None, float]:
    """Forest and threshold; stats: rows of ``rule_counts``, labels: (doc_id, label).

    The threshold is the one that sets apart most bad rows beyond good ones, among those that keep
    at least KEEP_GOOD of the good. Trees hold good rows; bad ones only widen the range of splits.
    Without good rows that pass the base rules there is no forest,
    and without bad ones the threshold keeps all labelled rows.
    """
    known = staged(
        stats.where("NOT base_failed").join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")
        .where("label IS NOT NULL").select("doc_id", "label", *COUNTS),
        "rules-known",
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).toPandas()
    rows, good = ratios(sample[COUNTS].to_numpy(np.int64)), (sample["label"] == 1).to_numpy(bool)
    if not good.any():
        return None, 1.0
    forest = Forest(rows[good], rows.min(axis=0), rows.max(axis=0))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            odd = forest.odd(ratios(frame[COUNTS].to_numpy(np.int64)))
            yield pd.DataFrame({"cell": (odd * CELLS).astype(int), "label": frame["label"]})

    table = (
        known.select("label", *COUNTS).mapInPandas(cells, "cell int, label int")
        .groupBy("cell").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
        .collect()  # at most CELLS + 1 rows
    )
    heights = np.zeros((CELLS + 2, 2))
    for row in table:
        heights[row["cell"]] += row["good"], row["bad"]
    gone = heights[::-1].cumsum(axis=0)[::-1] / np.maximum(heights.sum(axis=0), 1)
    allowed = gone[:, 0] <= 1 - KEEP_GOOD
    gain = np.where(allowed, gone[:, 1] - gone[:, 0], -1.0)
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return forest, best / CELLS


def judge(stats: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """Adds odd, the score of the forest (0 without one), and kept: neither failed nor odder than allowed."""
    columns = stats.columns

    def run(batch: pa.RecordBatch) -> dict:
        rows = np.column_stack([batch.column(c).to_numpy() for c in COUNTS])
        odd = forest.odd(ratios(rows)) if forest else np.zeros(len(rows))
        return {c: batch.column(c) for c in columns} | {"odd": pa.array(odd)}

    schema = ", ".join(f"{c} {kind}" for c, kind in [*stats.dtypes, ("odd", "double")])
    judged = arrow_map(stats, columns, schema, run)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("odd") < threshold))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, odd, kept) for every document, repeated rows included.

    Null and empty texts have no words and fail the base rules; texts are counted whole, however long. Equal
    counts have equal verdicts. Labels that are null, or of unknown documents, are not used; for too few labels
    see ``fit``. Rows without doc_id are judged like all others. An empty table gives an empty result; other
    columns are left out, whatever their names.
    """
    stats = staged(rule_counts(docs), "rules-counts")
    return judge(stats, *fit(stats, labels))
