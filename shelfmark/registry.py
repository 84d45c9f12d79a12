"""The catalogue tables on Parquet: append-only batches, one commit record per batch.

Layout below ``root``:

* ``<table>/batch=<id>-<part>-<unique>`` holds the rows of one write; ``<table>/lots=<unique>/lot=<n>/batch=...`` those of a
  lot, of which several are written by one job. An ``insert`` part has new keys only;
  a ``change`` part has whole new versions of rows, or deletions; a ``base`` part replaces all
  that came before it, and may be dealt to buckets for joins of large tables.
* ``commits/<id>`` is one small file, created last and never replaced. A batch without it does not
  exist for readers, so all tables of a batch appear together or not at all. Parts have unique
  names, and of two writers of the same id the second is refused.
* ``snapshots/<id>`` sums up the commits up to that one, so that readers take one snapshot and the
  few commits after it.

Reading a table without change parts is a plain scan. Otherwise only the change parts are reduced
to their last version; the rest is scanned once and anti-joined with the changed keys.

One writer at a time succeeds; readers are free.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import storage
from shelfmark.errors import (
    ConcurrentWriteError,
    DuplicateImageError,
    ImageInUseError,
    ImageNotFoundError,
    InvalidRowError,
)
from shelfmark.functions.columns import valid_location, valid_size, validity
from shelfmark.operators import changes, checks
from shelfmark.operators.dedup import HASH_ROW_BYTES, duplicate_hashes
from shelfmark.operators.joins import lookup_join
from shelfmark.schema import NEW_IMAGE_COLUMNS, TABLES, UPDATABLE_COLUMNS, Table
from shelfmark.session import empty_table, staged_with_counts

INSERT, CHANGE, BASE = "insert", "change", "base"
PUT, DELETE = "U", "D"
CHILD_TABLES = ("model_tags", "manual_tags", "notes")
# Commits between two snapshots; at most twice as many records are read for a state.
COMMITS_PER_SNAPSHOT = 50
# Columns with a Bloom filter in each row group, so that look-ups of single keys skip files.
LOOKUP_COLUMNS = ("hash", "image_id", "tag")

CHANGE_FIELDS = [
    T.StructField("_op", T.StringType()),
    T.StructField("_batch", T.LongType()),
    T.StructField("_part", T.IntegerType()),
]

@dataclass(frozen=True)
class Part:
    """One write of one table: where it is below the root and what it means for readers."""

    table: str
    kind: str
    path: str
    rows: int
    buckets: int = 0


@dataclass(frozen=True)
class State:
    """What the commit records add up to since the catalogue was last emptied. Its size grows with batches,
    not with rows."""

    batch_id: int = -1
    next_image_id: int = 1
    parts: tuple[Part, ...] = ()
    labels: frozenset[str] = frozenset()
    since: int = 0

    @staticmethod
    def from_record(record: dict) -> State:
        parts = tuple(Part(**part) for part in record["parts"])
        labels = frozenset(record["labels"])
        return State(record["batch_id"], record["next_image_id"], parts, labels, record.get("since", 0))

    def record(self) -> dict:
        return {
            "batch_id": self.batch_id,
            "next_image_id": self.next_image_id,
            "parts": [asdict(part) for part in self.parts],
            "labels": sorted(self.labels),
            "since": self.since,
        }

    def with_parts(self, parts: Sequence[Part]) -> State:
        live = list(self.parts)
        for part in parts:
            if part.kind == BASE:
                live = [p for p in live if p.table != part.table]
            live.append(part)
        return replace(self, parts=tuple(live))

    def rows(self, table: str) -> int:
        """Rows written to a table since its base: an upper bound of its current rows."""
        return sum(part.rows for part in self.parts if part.table == table)


class Registry:
    """Reads and writes the catalogue below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root

    # ---- set-up -------------------------------------------------------------------------------

    def init(self, overwrite: bool = False) -> Registry:
        """Create the catalogue if it is missing. ``overwrite`` starts an empty one, ids from 1."""
        state = self._state_or_none()
        if state is None:
            if not self._commit(0, None, 1, True, []) and self._state_or_none() is None:
                self._commit(1, None, 1, True, [])  # an earlier call stopped half-way
        elif overwrite:
            self._commit(self._last_commit() + 1, None, 1, True, [])
        return self

    def _commit(
        self, batch_id: int, label: str | None, next_id: int, reset: bool, parts: Sequence[Part]
    ) -> bool:
        """Create the marker of a batch; False if that batch exists."""
        record = {
            "label": label,
            "next_image_id": next_id,
            "reset": reset,
            "parts": [asdict(part) for part in parts],
        }
        path = os.path.join(self.root, "commits", str(batch_id))
        done = storage.create(self.spark, path, json.dumps(record))
        if done and batch_id and batch_id % COMMITS_PER_SNAPSHOT == 0:
            snapshot = os.path.join(self.root, "snapshots", str(batch_id))
            storage.create(self.spark, snapshot, json.dumps(self.state().record()))
        return done

    def _records(self, folder: str) -> list[int]:
        return sorted(int(n) for n in storage.names(self.spark, os.path.join(self.root, folder)) or [] if n.isdigit())

    def _last_commit(self) -> int:
        return max(self._records("commits"), default=-1)

    def _state_or_none(self) -> State | None:
        commits = self._records("commits")
        state, found = State(), False
        for number in reversed(self._records("snapshots")):
            text = storage.read(self.spark, os.path.join(self.root, "snapshots", str(number)))
            if text.endswith("}"):  # whole, not left by a writer that was lost
                state, found = State.from_record(json.loads(text)), True
                break
        for number in commits:
            if number <= state.batch_id:
                continue
            text = storage.read(self.spark, os.path.join(self.root, "commits", str(number)))
            if not text.endswith("}"):  # its writer was lost: no batch, and its number is not used again
                continue
            record = json.loads(text)
            found = True
            state = State(since=number) if record["reset"] else state
            labels = state.labels | ({record["label"]} if record["label"] else set())
            state = replace(
                state.with_parts([Part(**part) for part in record["parts"]]),
                batch_id=number,
                next_image_id=record["next_image_id"],
                labels=frozenset(labels),
            )
        return state if found else None

    def state(self) -> State:
        state = self._state_or_none()
        if state is None:
            raise FileNotFoundError(f"no catalogue at {self.root}; call init() first")
        return state

    def has_batch(self, label: str) -> bool:
        return label in self.state().labels

    # ---- reads --------------------------------------------------------------------------------

    def read(self, table: str, state: State | None = None) -> DataFrame:
        """Current rows of a table."""
        layout = TABLES[table]
        parts = [p for p in (state or self.state()).parts if p.table == table and p.rows]
        whole = [p for p in parts if p.kind != CHANGE]
        if len(whole) == 1 and whole[0].buckets:
            plain = self._scan_buckets(whole[0], layout)
        else:
            plain = self._scan([p.path for p in whole], layout.schema)
        changed = [p.path for p in parts if p.kind == CHANGE]
        if not changed:
            return plain
        versions = self._scan(changed, T.StructType([*layout.schema.fields, *CHANGE_FIELDS]))
        latest = changes.last_per_key(versions, layout.key, F.struct("_batch", "_part"))
        live = latest.where(F.col("_op") == PUT).select(*layout.columns)
        touched = versions.select(*layout.key).distinct()
        return changes.replaced(plain.select(*layout.columns), touched, live, layout.key)

    def _scan(self, paths: Sequence[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return empty_table(self.spark, schema)
        return self.spark.read.schema(schema).parquet(*[os.path.join(self.root, p) for p in paths])

    def _scan_buckets(self, part: Part, layout: Table) -> DataFrame:
        """A part of buckets: joins and groupings by its column need no shuffle of it."""
        name = f"buckets_{uuid.uuid4().hex}"
        path = os.path.join(self.root, part.path).replace("'", "\\'")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in layout.schema)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({layout.bucket}) INTO {part.buckets} BUCKETS "
            f"LOCATION '{path}'"
        )
        rows = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name alone; the frame keeps the files and their buckets
        return rows

    def images(self) -> DataFrame:
        return self.read("images")

    def model_tags(self) -> DataFrame:
        return self.read("model_tags")

    def manual_tags(self) -> DataFrame:
        return self.read("manual_tags")

    def notes(self) -> DataFrame:
        return self.read("notes")

    def tables(self) -> DataFrame:
        """Names of the tables."""
        return self.spark.createDataFrame([(name,) for name in TABLES], "name string")

    def create_views(self, prefix: str = "") -> None:
        """Current tables as temporary views, for SQL."""
        state = self.state()
        for table in TABLES:
            self.read(table, state).createOrReplaceTempView(prefix + table)

    # ---- writes -------------------------------------------------------------------------------

    def batch(self, label: str | None = None, state: State | None = None) -> Batch:
        """A unit of work over all tables; leaving the ``with`` block commits it.

        With the ``state`` it was planned on, a commit that came in between is refused as well.
        """
        return Batch(self, state or self.state(), label)

    def lot_batches(self, state: State, lots: Sequence[int]) -> LotBatches:
        """A batch for each of several lots, in their order, planned together on one state."""
        return LotBatches(self, state, Batch(self, state).batch_id, list(lots))

    def add_images(self, new: DataFrame, counted: bool = False) -> DataFrame:
        with self.batch() as batch:
            return batch.add_images(new, counted=counted)

    def upsert_tags(self, tags: DataFrame, table: str = "model_tags") -> None:
        with self.batch() as batch:
            batch.upsert(table, tags)

    def upsert_notes(self, notes: DataFrame) -> None:
        with self.batch() as batch:
            batch.upsert("notes", notes)

    def update_images(self, rows: DataFrame) -> None:
        with self.batch() as batch:
            batch.update_images(rows)

    def remove_images(self, ids: DataFrame | Sequence[int] | int) -> None:
        with self.batch() as batch:
            batch.remove_images(ids)

    def remove_tags(self, ids: DataFrame | Sequence[int] | int, table: str = "model_tags") -> int:
        with self.batch() as batch:
            return batch.remove_tags(ids, table)

    def archive_tags(self, keys: DataFrame, archived: bool = True) -> None:
        with self.batch() as batch:
            batch.archive_tags(keys, archived)

    def compact(self, table: str, buckets: int = 0) -> None:
        """Rewrite the current rows as one base, laid out for lookups by the table's sort order.

        With ``buckets`` the rows are dealt by the table's bucket column instead, images by hash and all
        else by image_id: until the next part comes, the check of new hashes shuffles only the new ones, and
        joins of tags with images do not shuffle the tags. Take at least as many as a shuffle has partitions.
        """
        state = self.state()
        parts = [p for p in state.parts if p.table == table]
        if len(parts) < 2 and all(p.kind == BASE and p.buckets == buckets for p in parts):
            return
        with self.batch(state=state) as batch:
            rows = self.read(table, state)
            if buckets:
                rows = rows.repartition(buckets, TABLES[table].bucket)
            else:
                rows = rows.repartitionByRange(*TABLES[table].sort)
            batch.write(table, BASE, rows, rebalance=False, buckets=buckets)


@dataclass
class Batch:
    """Writes that become visible together."""

    registry: Registry
    before: State
    label: str | None = None
    parts: list[Part] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.batch_id = self.before.batch_id + 1
        taken = self.registry._records("commits")
        if taken and taken[-1] >= self.batch_id and self.registry.state() == self.before:
            self.batch_id = taken[-1] + 1  # numbers left by lost writers
        self.next_image_id = self.before.next_image_id

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind: type | None, value: object, trace: object) -> None:
        if kind is None and self.parts and not self.registry._commit(
            self.batch_id, self.label, self.next_image_id, False, self.parts
        ):
            raise ConcurrentWriteError(f"batch {self.batch_id} was committed by another writer")

    def read(self, table: str) -> DataFrame:
        """Current rows, with the pending writes of this batch."""
        return self.registry.read(table, self.before.with_parts(self.parts))

    def write(
        self, table: str, kind: str, rows: DataFrame, rebalance: bool = True, buckets: int = 0
    ) -> DataFrame:
        """Write one part, sorted inside its files, and count it on the way.

        ``rebalance`` evens out the files; rows that are partitioned by range already go without.
        """
        name = f"batch={self.batch_id}-{len(self.parts)}-{uuid.uuid4().hex}"
        path = os.path.join(table, name)
        seen = Observation()
        sized = rows.hint("rebalance") if rebalance else rows
        counted = sized.sortWithinPartitions(*TABLES[table].sort).observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = _with_filters(counted.write, table)
        if buckets:
            column, taken = TABLES[table].bucket, f"buckets_{uuid.uuid4().hex}"
            writer = writer.bucketBy(buckets, column).sortBy(column)
            writer.option("path", os.path.join(self.registry.root, path)).saveAsTable(taken)
            self.registry.spark.sql(f"DROP TABLE {taken}")
        else:
            writer.parquet(os.path.join(self.registry.root, path))
        self.parts.append(Part(table, kind, path, seen.get["rows"], buckets))
        return self.registry._scan([path], rows.schema)

    def write_changes(self, table: str, rows: DataFrame, op: str) -> DataFrame:
        marks = (op, self.batch_id, len(self.parts))
        added = [F.lit(m).cast(f.dataType).alias(f.name) for m, f in zip(marks, CHANGE_FIELDS, strict=True)]
        return self.write(table, CHANGE, rows.select(*TABLES[table].columns, *added))

    def add_images(self, new: DataFrame, checked: bool = False, counted: bool = False) -> DataFrame:
        """Insert images and give (hash, image_id). ``checked`` skips the null and hash rules. With ``counted`` the
        sides are counts, as of characters and lines, and may be zero or unknown, but not negative."""
        if not checked:
            nulls = checks.null_count(TABLES["images"].schema, NEW_IMAGE_COLUMNS).alias("nulls")
            sides = [F.col("width"), F.col("height")]
            if counted:
                sides = [F.coalesce(F.nullif(side, F.lit(0)), F.lit(1)) for side in sides]
            rule = validity(F.col("file_location"), F.col("hash"), *sides)
            new, seen = staged_with_counts(
                new.select(*NEW_IMAGE_COLUMNS), "new-images", nulls, F.count_if(rule != "ok").alias("invalid"),
                F.count(F.lit(1)).alias("rows"),
            )
            self._refuse("images", seen.nulls, seen.invalid)
            if not duplicate_hashes(new).isEmpty():
                raise DuplicateImageError("the batch holds the same hash more than once")
            registered = self.read("images").select("hash")
            size = seen.rows * HASH_ROW_BYTES
            if not lookup_join(
                registered, new.select("hash"), ["hash"], "left_semi", size
            ).isEmpty():
                raise DuplicateImageError("a hash is registered already")
        numbered = changes.numbered_images(new, self.next_image_id)
        written = self.write("images", INSERT, numbered, rebalance=False)
        self.next_image_id += self.parts[-1].rows
        return written.select("hash", "image_id")

    def add_new_tags(self, tags: DataFrame) -> None:
        """Insert the tags of images that this batch has added, whose keys are new by nature."""
        self.write("model_tags", INSERT, tags.select(*TABLES["model_tags"].columns))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Insert rows or replace whole rows of the same key, for tags and notes."""
        layout = TABLES[table]
        if "archived" in layout.columns and "archived" not in rows.columns:
            rows = rows.withColumn("archived", F.lit(False))
        rows, seen = staged_with_counts(
            rows.select([F.col(f.name).cast(f.dataType) for f in layout.schema]),
            table,
            F.count(F.lit(1)).alias("rows"),
            checks.null_count(layout.schema, layout.columns).alias("nulls"),
        )
        if seen.rows == 0:
            return
        self._refuse(table, seen.nulls)
        if not checks.orphans(rows, self.read("images")).isEmpty():
            raise ImageNotFoundError(f"{table}: a row refers to an image that is not registered")
        self.write_changes(table, changes.one_per_key(rows, layout.key), PUT)

    def update_images(self, rows: DataFrame) -> None:
        """Bulk update by image_id; unknown ids are ignored."""
        schema = TABLES["images"].schema
        given = ["image_id", *UPDATABLE_COLUMNS]
        one = F.lit(1)  # sides may be unknown, but not zero or below
        sides = [F.coalesce(side, one) for side in ("width", "height")]
        valid = valid_location(F.col("file_location")) & valid_size(*sides)
        rows, seen = staged_with_counts(
            rows.select(*given), "image-updates", F.count(F.lit(1)).alias("rows"),
            checks.null_count(schema, given).alias("nulls"), F.count_if(~valid).alias("invalid"),
        )
        if seen.rows == 0:
            raise ValueError("nothing to update")
        self._refuse("images", seen.nulls, seen.invalid)
        self.write_changes("images", changes.changed_images(self.read("images"), rows), PUT)

    def remove_images(self, ids: DataFrame | Sequence[int] | int) -> None:
        """Delete images; unknown ids are ignored, images with tags or notes are refused."""
        wanted = self._ids(ids)
        if wanted.isEmpty():
            raise ValueError("nothing to remove")
        if not checks.in_use(wanted, *[self.read(t) for t in CHILD_TABLES]).isEmpty():
            raise ImageInUseError("an image to remove still has tags or a note")
        gone = self._of(self.read("images"), wanted)
        self.write_changes("images", gone, DELETE)

    def remove_tags(self, ids: DataFrame | Sequence[int] | int, table: str = "model_tags") -> int:
        """Delete all tags of the given images and return their number."""
        gone = self._of(self.read(table), self._ids(ids))
        self.write_changes(table, gone, DELETE)
        return self.parts[-1].rows

    def archive_tags(self, keys: DataFrame, archived: bool = True) -> None:
        """Set the archive mark of the tags named by (image_id, category, tag)."""
        key = list(TABLES["model_tags"].key)
        wanted = keys.select(*key).distinct()
        marked = lookup_join(self.read("model_tags"), wanted, key, "left_semi")
        self.write_changes("model_tags", marked.withColumn("archived", F.lit(archived)), PUT)

    def _ids(self, ids: DataFrame | Sequence[int] | int) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select("image_id").distinct()
        listed = ([ids] if ids else []) if isinstance(ids, int) else list(dict.fromkeys(ids))
        return self.registry.spark.createDataFrame(pa.table({"image_id": pa.array(listed, pa.int64())}))

    def _of(self, rows: DataFrame, ids: DataFrame) -> DataFrame:
        return lookup_join(rows, ids, ["image_id"], "left_semi")

    def _refuse(self, table: str, nulls: int, invalid: int = 0) -> None:
        if nulls:
            raise InvalidRowError(f"{table}: a required column is null in {nulls} rows")
        if invalid:
            raise InvalidRowError(f"{table}: location, hash or size is not valid in {invalid} rows")


@dataclass
class LotBatches:
    """Batches whose rows are written by one job for each table, and which are committed one by one.

    The rows have a column ``lot``; those of a lot are a part of its own, below a folder that the lots share.
    """

    registry: Registry
    before: State
    first: int
    lots: list[int]
    parts: dict[int, list[Part]] = field(default_factory=dict)

    def write(self, table: str, rows: DataFrame, counts: Mapping[int, int], rebalance: bool = True) -> DataFrame:
        """Insert the rows of all lots, of which ``counts`` tells how many each has; (lot, columns) are given back."""
        layout, number = TABLES[table], len(next(iter(self.parts.values()), []))
        folder = os.path.join(table, f"lots={uuid.uuid4().hex}")
        names = {lot: f"{self.first + i}-{number}-{uuid.uuid4().hex}" for i, lot in enumerate(self.lots)}
        cells = [F.lit(cell) for pair in names.items() for cell in pair]
        dealt = rows.select("lot", F.create_map(*cells)[F.col("lot")].alias("batch"), *layout.columns)
        sized = dealt.hint("rebalance", F.col("lot")) if rebalance else dealt
        writer = _with_filters(sized.sortWithinPartitions("lot", "batch", *layout.sort).write, table)
        writer.partitionBy("lot", "batch").parquet(os.path.join(self.registry.root, folder))
        for lot, name in names.items():
            path = os.path.join(folder, f"lot={lot}", f"batch={name}")
            self.parts.setdefault(lot, []).append(Part(table, INSERT, path, counts[lot]))
        placed = [T.StructField("lot", T.IntegerType()), T.StructField("batch", T.StringType())]
        return self.registry._scan([folder], T.StructType([*layout.schema.fields, *placed]))

    def commit(self, lot: int, label: str | None, next_image_id: int) -> bool:
        """Make a lot visible; False, and nothing done, if another writer has taken its number."""
        number = self.first + self.lots.index(lot)
        return self.registry._commit(number, label, next_image_id, False, self.parts[lot])


def _with_filters(writer: DataFrameWriter, table: str) -> DataFrameWriter:
    """With a Bloom filter for each column that look-ups name."""
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")  # no larger than the rows ask for
    for column in LOOKUP_COLUMNS:
        if column in TABLES[table].columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer
