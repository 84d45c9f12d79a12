"""Line dedup with levelled sorted runs.

A run is a table of line keys with the number of documents that hold them, bucketed and sorted by
the key's hash. Each new batch is counted, leaves out by merge joins with the runs of settled keys
what is known to be frequent already, and is added as a run of its own. When a level has enough
runs they are merged into one of the next level; keys that reach the threshold move to the settled
runs.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, ascii_lower, free_name
from shelfmark.operators.joins import MAX_BROADCAST_BYTES
from shelfmark.session import new_workspace, staged, staged_with_counts

# Runs of one level that are merged into one of the next.
FANOUT = 3
# Batches into which a whole table is dealt.
BATCHES = 4
KEY = ["k1", "k2"]
RUN_SCHEMA = "k1 bigint, k2 bigint, n bigint"
KEY_ROW_BYTES = 48


class LineRuns:
    """The runs of one collection of lines. ``close`` forgets the tables; their files stay."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self._paths: dict[str, str] = {}

    def add(self, counts: DataFrame) -> None:
        """Add a batch: rows (k1, k2, n), n documents of the batch hold the key. Keys may repeat."""
        fresh = counts.groupBy(*KEY).agg(F.sum("n").alias("n"))
        for run in self.settled:
            fresh = fresh.join(self.spark.table(run).select(*KEY), KEY, "left_anti")
        self.levels[0].append(self._write(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def frequent(self) -> tuple[DataFrame, int]:
        """All keys found in at least ``min_docs`` documents, and their number."""
        runs = [run for level in self.levels for run in level]
        found = [self._merged(runs).where(F.col("n") >= self.min_docs).select(*KEY)] if runs else []
        found += [self._rows(self.settled).select(*KEY)] if self.settled else []
        keys, counts = staged_with_counts(
            functools.reduce(DataFrame.unionByName, found), "line-frequent", F.count(F.lit(1)).alias("n")
        )
        return keys, counts["n"]

    def close(self) -> None:
        for name in self._paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._paths = {}

    def _rows(self, runs: list[str]) -> DataFrame:
        """Rows of several runs in one scan; a union of bucketed tables would be taken for bucketed."""
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[self._paths[run] for run in runs])

    def _merged(self, runs: list[str]) -> DataFrame:
        return self._rows(runs).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def _compact(self, level: int) -> None:
        merged = staged(self._merged(self.levels[level]), "line-merge")
        self.levels[level] = []
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.settled.append(self._write(merged.where(F.col("n") >= self.min_docs)))
        self.levels[level + 1].append(self._write(merged.where(F.col("n") < self.min_docs)))
        if len(self.settled) >= self.fanout:  # settled keys are disjoint: a merge is a union
            self.settled = [self._write(self._rows(self.settled))]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = new_workspace(self.spark, "line-run")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (
            rows.repartition(buckets, *KEY)
            .write.bucketBy(buckets, *KEY)
            .sortBy(*KEY)
            .option("path", path)
            .saveAsTable(name)
        )
        self._paths[name] = path
        return name


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A to Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = BATCHES) -> tuple[DataFrame, int]:
    """Hashes (k1, k2) of the keys that at least ``min_docs`` rows hold, and how many there are.

    128 bits of hash stand for a key. The texts are read once: counts are summed per task before
    the shuffle, stored by batch, and the batches then enter the runs one after the other.
    """
    spark = docs.sparkSession
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    counts = (
        docs.select(
            F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"),
            F.explode(F.filter(keys, lambda key: F.char_length(key) >= min_chars)).alias("key"),
        )
        .select("batch", *_hashes(F.col("key")))
        .groupBy("batch", *KEY)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    path = new_workspace(spark, "line-counts")
    counts.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema("k1 bigint, k2 bigint, n bigint, batch int").parquet(path)
    runs = LineRuns(spark, min_docs)
    try:
        for batch in range(batches):
            runs.add(stored.where(F.col("batch") == batch).select(*KEY, "n"))
        return runs.frequent()
    finally:
        runs.close()


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """The documents without the lines whose key at least ``min_docs`` documents hold.

    Adds n_lines (before) and n_dropped; columns of these names are replaced. Each row counts as a
    document, also one that repeats a doc_id. Null or empty texts have one empty line, which is
    kept for its key is shorter than ``min_chars``; a null text stays null. A document that loses
    all lines stays with an empty text.
    """
    kept = docs.drop("n_lines", "n_dropped")
    drop, doc, mark = (free_name(kept, n) for n in ("line_drop", "line_doc", "line_text"))
    keys, n_keys = frequent_lines(docs.select("doc_id", "text"), min_docs, min_chars, batches)
    lines = kept.select("doc_id", F.xxhash64("text").alias(mark), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    hashed = lines.where("line <> ''").select("doc_id", mark, "pos", *_hashes(line_key(F.col("line"))))
    if n_keys * KEY_ROW_BYTES <= MAX_BROADCAST_BYTES:
        keys = F.broadcast(keys)
    hits = (
        hashed.join(keys, KEY, "left_semi")
        .groupBy(F.col("doc_id").alias(doc), F.col(mark).alias(f"{mark}2"))
        .agg(F.collect_set("pos").alias(drop))
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(f"{mark}2"))
    split = lines_of(F.col("text"))
    return (
        kept.join(hits, same, "left")
        .withColumn("n_lines", F.size(split).cast("bigint"))
        .withColumn("n_dropped", F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("bigint"))
        .withColumn("text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(_without(split, F.col(drop))))
        .select(*kept.columns, "n_lines", "n_dropped")
    )


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2")]


def _without(lines: Column, drop: Column) -> Column:
    """The lines but those at the given positions, in time linear in the text."""
    def kept(all_lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), drop)
        return F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")

    return F.element_at(F.transform(F.array(lines), kept), 1)
