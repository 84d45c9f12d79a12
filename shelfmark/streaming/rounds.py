"""Rounds over a growing folder.

A clock of Spark's own gives the micro-batches, and each of them is one round: the folder is listed as in a
batch run, and what is due goes through in lots. Lots of small files that follow each other are worked on together,
up to LOTS_TOGETHER lots or BYTES_TOGETHER bytes, so that a round takes no jobs for each of them. Due is what the listing of the round before did not have with
this path, time and length, so that changed files come again, and what could not be read or scored, a bounded
number of times. Listing, due files and files to try again are stored below the checkpoint under the number of
the micro-batch before they are worked on: a round that broke off is the same when it runs again. Only the last
two rounds are kept, so what is stored grows with the folder and not with time.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import storage
from shelfmark.plans.register import Registration, unsettled
from shelfmark.session import staged
from shelfmark.sources.files import FileStream

# Rounds in which one version of a file is tried.
MAX_ATTEMPTS = 3
# Rows of one partition in the numbers of monotonically_increasing_id.
_PART_BITS = 33
_LISTED = "path string, modificationTime timestamp, length bigint"
# Most lots, and bytes of files, that are worked on together; a lot of more bytes is worked on alone.
LOTS_TOGETHER = 64
BYTES_TOGETHER = 1024 * 1024 * 1024


@dataclass(frozen=True)
class Position:
    """Where a lot stands. ``number`` counts the lots of all rounds from 0, ``lot`` those of its round from 1;
    ``offset`` files of the round come before it."""

    number: int
    lot: int
    lots: int
    offset: int
    files: int

    @property
    def is_first(self) -> bool:
        return self.lot == 1

    @property
    def is_last(self) -> bool:
        return self.lot == self.lots


Work = Callable[[DataFrame, Position, str], Registration]
# Files (path, modificationTime, length, at, lot) of lots that follow each other, the lots that are not done, a name
# that no other lots have, and where to tell what may go well another time; gives each lot's result after its commit.
Together = Callable[
    [DataFrame, Sequence[tuple[Position, str]], str, Callable[[int, DataFrame], None]],
    Iterator[tuple[Position, Registration]],
]


class Rounds:
    """Works off one round for each micro-batch of the clock. ``work`` gets the files of a lot, its position and
    a name for it that no other lot has. ``together``, if given, takes its place for all lots."""

    def __init__(self, stream: FileStream, work: Work, checkpoint: str, together: Together | None = None):
        self._stream, self._work, self._together = stream, work, together
        self._spark = stream.spark
        self._root = os.path.join(checkpoint, "rounds")

    def __call__(self, clock: DataFrame, number: int) -> None:
        name = self._identity()
        folder = self._at(number)
        for old in storage.names(self._spark, self._root) or []:
            if old.isdigit() and int(old) < number - 1:
                storage.delete(self._spark, os.path.join(self._root, old))
        due, sizes, first, stretches = self._due(number)
        if self._together:
            self._stretches(due, sizes, first, stretches, folder, name)
            self._keep_tries(due, folder)
            return
        for position, lot in self._lots(due, sizes, first):
            failed = os.path.join(folder, "failed", str(position.lot))
            if self._complete(failed):
                continue
            result = self._work(lot, position, f"{name}:{position.number}")
            paths = unsettled(result)
            if paths is not None:
                staged(paths, str(position.lot), os.path.join(folder, "failed"))
            result.release()
        self._keep_tries(due, folder)

    def _at(self, number: int) -> str:
        return os.path.join(self._root, str(number))

    def _complete(self, path: str) -> bool:
        return storage.exists(self._spark, os.path.join(path, "_SUCCESS"))

    def _read(self, number: int, name: str, schema: str) -> DataFrame:
        """A table of a round, empty if there is none."""
        path = os.path.join(self._at(number), name)
        if not self._complete(path):
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(path)

    def _identity(self) -> str:
        """A name of this checkpoint, so that another one under the same label is not taken for it."""
        path = os.path.join(self._root, "name")
        storage.create(self._spark, path, uuid.uuid4().hex)
        return storage.read(self._spark, path)

    def _record(self, number: int) -> dict | None:
        path = os.path.join(self._at(number), "record")
        text = storage.read(self._spark, path) if storage.exists(self._spark, path) else ""
        return json.loads(text) if text.endswith("}") else None

    def _due(self, number: int) -> tuple[DataFrame, list[tuple[int, int]], int, list[int]]:
        """Files of a round in the order of time and path, rows of each of their partitions, number of the first lot,
        and how many lots are worked on together, one stretch after the other."""
        folder, record = self._at(number), self._record(number)
        if record is None:
            listing = staged(self._stream.listing().select("path", "modificationTime", "length"), "listing", folder)
            before, tries = self._read(number - 1, "listing", _LISTED), self._read(number - 1, "tries", f"{_LISTED}, attempt int")
            new = _versions(listing, before, "left_anti").withColumn("attempt", F.lit(1))
            again = _versions(tries, listing, "left_semi").withColumn("attempt", F.col("attempt") + 1)
            ordered = new.unionByName(again).repartitionByRange("modificationTime", "path")
            due = staged(
                ordered.sortWithinPartitions("modificationTime", "path").withColumn("at", F.monotonically_increasing_id()),
                "due", folder,
            )
            parts = due.groupBy(F.shiftright("at", _PART_BITS).alias("part")).count().orderBy("part").collect()
            past = self._record(number - 1) or {"next": 0}
            files = sum(r["count"] for r in parts)
            lots = -(-files // self._stream.files_per_batch)
            record = {
                "first": past["next"], "next": past["next"] + lots, "parts": [[r["part"], r["count"]] for r in parts],
            }
            if self._together and lots:
                record["stretches"] = self._cut(due, [tuple(p) for p in record["parts"]], lots)
            storage.delete(self._spark, os.path.join(folder, "record"))
            storage.create(self._spark, os.path.join(folder, "record"), json.dumps(record))
        due = self._spark.read.schema(f"{_LISTED}, attempt int, at bigint").parquet(os.path.join(folder, "due"))
        stretches = record.get("stretches") or [1] * (record["next"] - record["first"])
        return due, [tuple(p) for p in record["parts"]], record["first"], stretches

    def _cut(self, due: DataFrame, sizes: list[tuple[int, int]], lots: int) -> list[int]:
        """Numbers of lots in the stretches, by the lengths that the listing tells."""
        starts = [(part, start - size) for (part, size), start in zip(sizes, accumulate(s for _, s in sizes), strict=True)]
        before = F.broadcast(self._spark.createDataFrame(starts, "part bigint, start bigint"))
        part = F.shiftright("at", _PART_BITS).alias("part")
        rank = F.col("at") - F.shiftleft("part", _PART_BITS) + F.col("start")
        lot = F.floor(rank / self._stream.files_per_batch).cast("int").alias("lot")
        placed = due.select("at", "length", part).join(before, "part").groupBy(lot)
        bytes_ = {r["lot"]: r["bytes"] or 0 for r in placed.agg(F.sum("length").alias("bytes")).collect()}
        stretches, total = [], 0
        for i in range(lots):
            total += bytes_.get(i, 0)
            if stretches and stretches[-1] < LOTS_TOGETHER and total <= BYTES_TOGETHER:
                stretches[-1] += 1
            else:
                stretches.append(1)
                total = bytes_.get(i, 0)
        return stretches

    def _stretches(
        self, due: DataFrame, sizes: list[tuple[int, int]], first: int, stretches: list[int], folder: str, name: str
    ) -> None:
        place, files, each = self._places(sizes), sum(size for _, size in sizes), self._stream.files_per_batch
        lots, start = sum(stretches), 0

        def mark(lot: int) -> str:
            return os.path.join(folder, "failed", str(lot), "_SUCCESS")

        def settle(lot: int, paths: DataFrame) -> None:
            staged(paths, str(lot - first + 1), os.path.join(folder, "unsettled"))

        for size in stretches:
            indexes = range(start, start + size)
            todo = [i for i in indexes if not storage.exists(self._spark, mark(i + 1))]
            start += size
            if not todo:
                continue
            positions = {first + i: Position(first + i, i + 1, lots, i * each, files) for i in todo}
            ends = [place(i * each) for i in range(todo[0] + 1, start)]
            low, high = place(todo[0] * each), place(start * each)
            passed = F.size(F.filter(F.lit(ends), lambda end: end <= F.col("at"))) if ends else F.lit(0)
            taken = due.where((F.col("at") >= low) & (F.col("at") < high)).select(
                "path", "modificationTime", "length", "at", (F.lit(first + todo[0]) + passed).cast("int").alias("lot")
            )
            known = f"{name}:{first + indexes[0]}-{first + indexes[-1]}"
            named = [(position, f"{name}:{number}") for number, position in positions.items()]
            for position, result in self._together(taken, named, known, settle):
                storage.create(self._spark, mark(position.lot), "")
                result.release()

    def _lots(self, due: DataFrame, sizes: list[tuple[int, int]], first: int) -> Iterator[tuple[Position, DataFrame]]:
        """Each lot is a range of places, so that its files are found by the ranges in the table's footers."""
        place, files, each = self._places(sizes), sum(size for _, size in sizes), self._stream.files_per_batch
        lots = -(-files // each)
        for i in range(lots):
            low, high = place(i * each), place((i + 1) * each)
            lot = due.where((F.col("at") >= low) & (F.col("at") < high)).select("path", "modificationTime", "length")
            yield Position(first + i, i + 1, lots, i * each, files), lot

    @staticmethod
    def _places(sizes: list[tuple[int, int]]) -> Callable[[int], int]:
        """The number in column ``at`` of the file that has a rank, or of what comes after the last one."""
        ends = list(accumulate(size for _, size in sizes))

        def place(rank: int) -> int:
            i = bisect_right(ends, rank)
            if i == len(ends):
                return (sizes[-1][0] + 1) << _PART_BITS
            return (sizes[i][0] << _PART_BITS) + rank - (ends[i] - sizes[i][1])

        return place

    def _failed(self, folder: str) -> DataFrame | None:
        """Paths of the files that failed in a round. Of lots that were planned again, what the last plan told."""
        record, tables = self._record(int(os.path.basename(folder))) or {}, []
        if "stretches" not in record:  # lots that were worked off one by one
            root = os.path.join(folder, "failed")
            parts = [os.path.join(root, n) for n in storage.names(self._spark, root) or []]
            tables = [self._spark.read.schema("path string").parquet(*parts)] if parts else []
        root = os.path.join(folder, "unsettled")
        begun = sorted(int(n) for n in storage.names(self._spark, root) or [])
        for lot, following in zip(begun, [*begun, None][1:], strict=False):
            table = self._spark.read.schema("lot int, path string").parquet(os.path.join(root, str(lot)))
            own = F.lit(True) if following is None else F.col("lot") < record["first"] + following - 1
            tables.append(table.where(own).select("path"))
        return reduce(DataFrame.unionByName, tables) if tables else None

    def _keep_tries(self, due: DataFrame, folder: str) -> None:
        """What the next round tries again: files that failed, and have attempts left."""
        paths = self._failed(folder)
        if paths is not None:
            tries = due.where(F.col("attempt") < MAX_ATTEMPTS).join(paths, "path", "left_semi")
            staged(tries.select("path", "modificationTime", "length", "attempt"), "tries", folder)


def _versions(files: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Files of which the other table has the same version, or has not."""
    others = others.select(*(F.col(c).alias(f"other_{c}") for c in ("path", "modificationTime", "length")))
    same = (F.col("path") == F.col("other_path")) & F.col("length").eqNullSafe(F.col("other_length"))
    return files.join(others, same & F.col("modificationTime").eqNullSafe(F.col("other_modificationTime")), how)
