"""The register flow: scan, skip what is known, score, sort by outcome, number, store."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from math import ceil
from typing import Any

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import storage
from shelfmark.errors import ConcurrentWriteError, InvalidRowError
from shelfmark.functions.columns import content_hash
from shelfmark.operators.changes import numbered_images
from shelfmark.operators.dedup import against_registry, keep_first, within_batch
from shelfmark.operators.joins import lookup_join
from shelfmark.operators.metadata import extract_metadata, file_metadata, skipped_files, valid_files
from shelfmark.operators.outcome import FAILURE, SUCCESS, classify, count_columns
from shelfmark.operators.scoring import ScorerFactory, score_assets
from shelfmark.operators.tags import decode_hits, to_tag_rows
from shelfmark.registry import Registry, State
from shelfmark.schema import DEFAULT_THRESHOLD, NEW_IMAGE_COLUMNS
from shelfmark.session import new_workspace, shared_dir, staged, staged_with_counts
from shelfmark.sources.files import list_files

# Most files and bytes one scoring task is planned for.
FILES_PER_TASK = 2000
BYTES_PER_TASK = 512 * 1024 * 1024
# Size of the 64-bit hash of a path in a broadcast.
PATH_KEY_BYTES = 32
# Marks the intermediate tables of a run that came to its end.
DONE = "_DONE"


def fresh_files(
    valid: DataFrame,
    registered: DataFrame,
    on_duplicate: str = "keep_first",
    registered_rows: int | None = None,
) -> DataFrame:
    """Files to score: not registered yet, one per hash."""
    return within_batch(against_registry(valid, registered, registered_rows), on_duplicate)


def successful(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") == SUCCESS)


def registration_plan(
    files: DataFrame, tags: DataFrame, first_id: int | Column
) -> tuple[DataFrame, DataFrame]:
    """Image and tag rows of a registration as one lazy plan, nothing stored.

    ``files`` have been scored (hash, error, ...); ``tags`` are theirs (hash, category, tag, score).
    """
    images = numbered_images(successful(classify(files, tags, ["hash"])), first_id)
    return images, to_tag_rows(tags.join(images.select("hash", "image_id"), "hash"))


def new_tag_rows(
    scored: DataFrame, ids: DataFrame, vocab: DataFrame, vocab_bytes: int | None = None, lot: Sequence[str] = ()
) -> DataFrame:
    """Tag rows of the scored files that got an id; of several lots with the column ``lot`` that tells which.

    Ids join the one-row-per-file form; tags are unfolded after that, without another shuffle.
    """
    numbered = scored.select(*lot, "hash", "positions", "scores").join(ids, [*lot, "hash"])
    return to_tag_rows(decode_hits(numbered, vocab, [*lot, "image_id"], vocab_bytes), lot)


@dataclass(frozen=True)
class Registration:
    """What a run did: counts, the metadata of all files and the outcome of the scored ones.

    ``known`` counts registered files and further copies within the batch. A stream tells the ``position``
    of each lot.
    """

    files: int = 0
    skipped: int = 0
    known: int = 0
    success: int = 0
    failure: int = 0
    empty: int = 0
    metadata: DataFrame | None = None
    outcomes: DataFrame | None = None
    workspace: str | None = None
    position: Any = None

    def release(self) -> None:
        """Remove the intermediate tables of the run, and with them metadata and outcomes."""
        if self.workspace and self.metadata is not None:
            storage.delete(self.metadata.sparkSession, self.workspace)

    @property
    def skipped_files(self) -> DataFrame | None:
        return None if self.metadata is None else skipped_files(self.metadata)


def unsettled(result: Registration) -> DataFrame | None:
    """Paths of the files that could not be read or scored, which may go well another time."""
    if result.metadata is None:
        return None
    paths = result.metadata.where(F.col("status") == "unreadable").select("path")
    if result.outcomes is None:
        return paths
    return paths.unionByName(result.outcomes.where(F.col("outcome") == FAILURE).select("path"))


def scoring_tasks(registry: Registry, files: int, size: int) -> int:
    """Tasks for the scorer by files and bytes to read; rows of metadata say little about it."""
    wanted = max(ceil(files / FILES_PER_TASK), ceil(size / BYTES_PER_TASK))
    return max(wanted, min(files, registry.spark.sparkContext.defaultParallelism))


def register(
    registry: Registry,
    files: DataFrame | str,
    scorer: ScorerFactory,
    vocab: DataFrame,
    *,
    threshold: float = DEFAULT_THRESHOLD,
    on_duplicate: str = "keep_first",
    recursive: bool = False,
    content: str | None = None,
    label: str | None = None,
    profile: ResourceProfile | None = None,
    unknown: Callable[[DataFrame, State], DataFrame] | None = None,
) -> Registration:
    """Register new files and their tags as one batch.

    ``files`` is a folder, all of whose files are listed, or a DataFrame (path, length, content). By
    default the tasks read the files by path, once for metadata and, those that remain, once for the
    scorer; a file that cannot be read is skipped with the reason. ``content="content"`` takes the
    bytes from the DataFrame instead, for files that exist only there: these are read twice as well, and go
    through a shuffle only when the files that remain are too many (two million) for a broadcast of 32 bytes for
    each. Nothing is written when no file is valid, all are known, or none succeeds.

    ``unknown`` may take the place of the check against the registered hashes: it gives the rows whose hash is
    not registered in a state of the registry. With a resource ``profile`` the scorer runs on executors that have what it asks for. A ``label`` makes the batch a no-op when it was committed before. If a run of that label broke
    off, its metadata and scores are found and used again.
    """
    spark = registry.spark
    state = registry.state()
    folder = _workspace(registry, label)
    if label and label in state.labels:
        return _left_by(registry, folder)
    vocab_bytes = _checked_vocabulary(vocab)
    if storage.exists(spark, os.path.join(folder, DONE)):  # that run came to its end, without a batch
        storage.delete(spark, folder)
    if isinstance(files, str):
        files = list_files(spark, files, recursive)
    facts = file_metadata(files) if content is None else extract_metadata(files)
    rows = F.count(F.lit(1)).alias("rows")
    skipped = F.count_if(F.col("status") != "ok").alias("skipped")
    metadata = _found(registry, folder, "metadata", facts.schema)
    if metadata is None:
        metadata, found = staged_with_counts(facts, "metadata", rows, skipped, folder=folder)
    else:
        found = metadata.agg(rows, skipped).first()
    valid = valid_files(metadata)
    if unknown is None:
        known = registry.read("images", state).select("hash")
        fresh = fresh_files(valid, known, on_duplicate, state.rows("images"))
    else:
        fresh = within_batch(unknown(valid, state), on_duplicate)
    size = F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")
    fresh, kept = staged_with_counts(fresh, "fresh", rows, size, folder=folder)
    result = Registration(
        files=found.rows,
        skipped=found.skipped,
        known=found.rows - found.skipped - kept.rows,
        metadata=metadata,
        workspace=folder,
    )
    if kept.rows == 0:
        storage.create(spark, os.path.join(folder, DONE), "")
        return result

    def scores(of: DataFrame, n: int, size: int) -> DataFrame:
        if content is None:
            spread = of.repartition(scoring_tasks(registry, n, size), "hash")
            return score_assets(spread, scorer, content=None, threshold=threshold, profile=profile)
        # The bytes stay in the tasks that read them: hashes of the paths choose rows, and what a path's hash
        # chooses in vain, or the table lists twice, goes when the scores meet the files by hash.
        paths = of.select(F.xxhash64("path").alias("_path")).distinct()
        bytes_of = files.select(F.xxhash64("path").alias("_path"), F.col(content).alias("content"))
        chosen = lookup_join(bytes_of, paths, ["_path"], "left_semi", n * PATH_KEY_BYTES)
        hashed = chosen.select("content", content_hash(F.col("content")).alias("hash"))
        scored = score_assets(hashed, scorer, threshold=threshold, profile=profile).dropDuplicates(["hash"])
        return of.join(scored, "hash")

    scored = _all_scored(registry, folder, fresh, kept, scores, ["hash"])
    tags = decode_hits(scored, vocab, ["hash"], vocab_bytes)
    classified = classify(scored.drop("positions", "scores"), tags, ["hash"])
    outcomes, counts = staged_with_counts(classified, "outcomes", *count_columns(), folder=folder)
    if counts.any_success:
        with registry.batch(label, state) as batch:
            # one file of each hash, none of them registered, all with valid metadata
            ids = batch.add_images(successful(outcomes).select(*NEW_IMAGE_COLUMNS), checked=True)
            batch.add_new_tags(new_tag_rows(scored, ids, vocab, vocab_bytes))
    storage.create(spark, os.path.join(folder, DONE), "")
    for name in ("fresh", "scored", "scored-more"):
        storage.delete(spark, os.path.join(folder, name))
    return replace(
        result,
        success=counts.success,
        failure=counts.failure,
        empty=counts.empty,
        outcomes=outcomes,
    )


def register_lots(
    registry: Registry,
    files: DataFrame,
    lots: Sequence[tuple[int, str]],
    scorer: ScorerFactory,
    vocab: DataFrame,
    *,
    name: str,
    threshold: float = DEFAULT_THRESHOLD,
    profile: ResourceProfile | None = None,
    unknown: Callable[[State], Callable[[DataFrame, State], DataFrame] | None] = lambda state: None,
    settle: Callable[[int, DataFrame], None] = lambda first, paths: None,
) -> Iterator[tuple[int, Registration]]:
    """Register lots of listed files (lot, path, length, at), each as a batch of its own, and give each one's result
    after its commit. Tables are as if ``register`` had been called for one lot after the other, with copies kept by
    ``keep_first``; but the files are read, compared, scored and written by the same few jobs for all of them.

    ``lots`` are numbers and labels in their order, ``name`` is the same for the lots whenever they run again, as
    after a failure: metadata and scores of the run before are then used again. Of a content that several lots hold,
    the first file is scored, and the others, together, only where that gave no tags. If another writer commits in
    between, the lots that remain are planned anew, one at a time. ``unknown`` gives the check of ``register`` for a
    state. ``settle`` is told the number of the first lot and (lot, path) of all files that may go well another
    time, before any of these lots is committed.
    """
    folder, state = _workspace(registry, name), registry.state()
    waiting = []
    for lot, label in lots:
        if label in state.labels:
            yield lot, _lot_left_by(registry, folder, lot)
        else:
            waiting.append((lot, label))
    vocab_bytes = _checked_vocabulary(vocab)
    at_once = len(waiting)
    while waiting:
        done = 0
        for lot, result in _lots_together(
            registry, folder, files, waiting[:at_once], scorer, vocab, vocab_bytes, threshold, profile, unknown, settle
        ):
            done += 1
            yield lot, result
        if done < min(at_once, len(waiting)):
            if at_once == 1:
                raise ConcurrentWriteError(f"the batch of {waiting[0][1]} was committed by another writer")
            at_once = 1
        waiting = waiting[done:]
    storage.delete(registry.spark, folder)


def _lots_together(
    registry: Registry,
    folder: str,
    files: DataFrame,
    lots: Sequence[tuple[int, str]],
    scorer: ScorerFactory,
    vocab: DataFrame,
    vocab_bytes: int,
    threshold: float,
    profile: ResourceProfile | None,
    unknown: Callable[[State], Callable[[DataFrame, State], DataFrame] | None],
    settle: Callable[[int, DataFrame], None],
) -> Iterator[tuple[int, Registration]]:
    """Results of the lots up to the first one whose number another writer took."""
    state, key = registry.state(), ["lot", "hash"]
    numbers = [lot for lot, _ in lots]
    rows, size = F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")
    metadata = _lot_metadata(registry, folder, files).where(F.col("lot").isin(numbers))
    ok = F.col("status") == "ok"
    found = {r.lot: r for r in metadata.groupBy("lot").agg(rows, F.count_if(~ok).alias("skipped")).collect()}
    valid, ask = valid_files(metadata), unknown(state)
    if ask is None:
        fresh = against_registry(valid, registry.read("images", state).select("hash"), state.rows("images"))
    else:
        fresh = ask(valid, state)
    turn = F.row_number().over(Window.partitionBy("hash").orderBy("lot"))
    first = F.col("turn") == 1
    fresh, kept = staged_with_counts(
        keep_first(fresh, key).withColumn("turn", turn), "fresh", F.count_if(first).alias("rows"),
        F.coalesce(F.sum(F.when(first, F.col("file_size"))), F.lit(0)).alias("bytes"), rows.alias("all"),
        size.alias("all_bytes"), folder=folder,
    )

    def scores(of: DataFrame, n: int, size: int) -> DataFrame:
        spread = of.repartition(scoring_tasks(registry, n, size), "hash")
        return score_assets(spread, scorer, content=None, threshold=threshold, profile=profile)

    def classified(scored: DataFrame) -> DataFrame:
        return classify(scored.drop("positions", "scores"), decode_hits(scored, vocab, key, vocab_bytes), key)

    def by_lot(outcomes: DataFrame, name: str) -> DataFrame:
        return staged(outcomes.hint("rebalance", F.col("lot")), name, folder, by="lot")

    outcomes, counts = None, {}
    storage.delete(registry.spark, os.path.join(folder, "outcomes-later"))
    if kept.rows:
        scored = _all_scored(registry, folder, fresh.where(first).drop("turn"), kept, scores, key)
        outcomes = by_lot(classified(scored), "outcomes")
        if kept.all > kept.rows:
            vain = outcomes.where(F.col("outcome") != SUCCESS).select("hash")
            later = lookup_join(fresh.where(~first).drop("turn"), vain, ["hash"], "left_semi")
            lacking = later.agg(rows, size).first()
            if lacking.rows:
                more = staged(scores(later, lacking.rows, lacking.bytes), "scored-later", folder)
                judged = classified(more)
                # a copy after the first one that gave tags is known
                until = successful(judged).groupBy("hash").agg(F.min("lot").alias("until"))
                needed = judged.join(until, "hash", "left").where("until IS NULL OR lot <= until").drop("until")
                outcomes = outcomes.unionByName(by_lot(needed.select(*outcomes.columns), "outcomes-later"))
                scored = scored.unionByName(more)
        tagged = F.coalesce(F.sum(F.when(F.col("outcome") == SUCCESS, F.col("n_tags"))), F.lit(0)).alias("tags")
        counts = {r.lot: r for r in outcomes.groupBy("lot").agg(*count_columns(), tagged).collect()}
    again = metadata.where(F.col("status") == "unreadable").select("lot", "path")
    if outcomes is not None:
        again = again.unionByName(outcomes.where(F.col("outcome") == FAILURE).select("lot", "path"))
    settle(numbers[0], again)
    won = [lot for lot in numbers if lot in counts and counts[lot].any_success]
    if won:
        batches = registry.lot_batches(state, won)
        images = numbered_images(successful(outcomes), state.next_image_id, lot="lot")
        ids = batches.write("images", images, {n: counts[n].success for n in won}, rebalance=False)
        tags = new_tag_rows(scored, ids.select(*key, "image_id"), vocab, vocab_bytes, lot=["lot"])
        batches.write("model_tags", tags, {n: counts[n].tags for n in won})
    next_id = state.next_image_id
    for lot, label in lots:
        of = counts.get(lot)
        if lot in won:
            next_id += of.success
            if not batches.commit(lot, label, next_id):
                return
        told = found.get(lot)
        files_, skipped = (told.rows, told.skipped) if told else (0, 0)
        result = Registration(
            files=files_,
            skipped=skipped,
            known=files_ - skipped - (of.total if of else 0),
            metadata=_of_lot(metadata, lot),
        )
        if of:
            result = replace(
                result, success=of.success, failure=of.failure, empty=of.empty, outcomes=_of_lot(outcomes, lot)
            )
        yield lot, result


def _of_lot(table: DataFrame, lot: int) -> DataFrame:
    return table.where(F.col("lot") == lot).drop("lot")


def _lot_metadata(registry: Registry, folder: str, files: DataFrame) -> DataFrame:
    """Metadata of the files of all lots, read once by as many tasks as the files ask for."""
    facts = file_metadata(files, ["lot"])
    metadata = _found(registry, folder, "metadata", facts.schema)
    if metadata is not None:
        return metadata
    seen = files.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    spread = files.repartitionByRange(max(1, scoring_tasks(registry, seen.rows, seen.bytes)), "at")
    return staged(file_metadata(spread, ["lot"]), "metadata", folder, by="lot")


def _all_scored(
    registry: Registry,
    folder: str,
    fresh: DataFrame,
    kept: Row,
    scores: Callable[[DataFrame, int, int], DataFrame],
    key: Sequence[str],
) -> DataFrame:
    """Scores of the files, of which a run that broke off may have left some."""
    plan = scores(fresh, kept.rows, kept.bytes)
    before = _found(registry, folder, "scored", plan.schema)
    if before is None:
        return staged(plan, "scored", folder)
    usable = lookup_join(before, fresh.select(*key), key, "left_semi")
    missing = lookup_join(fresh, before.select(*key), key, "left_anti")
    rows, size = F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")
    lacking = missing.agg(rows, size).first()
    if not lacking.rows:
        return usable
    return usable.unionByName(staged(scores(missing, lacking.rows, lacking.bytes), "scored-more", folder))


def _lot_left_by(registry: Registry, folder: str, lot: int) -> Registration:
    """A lot that was committed before: it counts nothing, but has the tables that were not removed yet."""
    whole = [n for n in ("metadata", "outcomes", "outcomes-later") if storage.exists(registry.spark, os.path.join(folder, n, "_SUCCESS"))]
    paths = {n: os.path.join(folder, n, f"lot={lot}") for n in whole}
    tables = {n: registry.spark.read.parquet(p) for n, p in paths.items() if storage.exists(registry.spark, p)}
    later = tables.pop("outcomes-later", None)
    if later is not None:
        tables["outcomes"] = tables["outcomes"].unionByName(later) if "outcomes" in tables else later
    return Registration(**tables)


def _left_by(registry: Registry, folder: str) -> Registration:
    """A committed run that is called again: it counts nothing, but has the tables that were not removed yet."""
    stored = {
        name: registry.spark.read.parquet(os.path.join(folder, name))
        for name in ("metadata", "outcomes")
        if storage.exists(registry.spark, os.path.join(folder, name, "_SUCCESS"))
    }
    return Registration(workspace=folder, **stored)


def _checked_vocabulary(vocab: DataFrame) -> int:
    """Its size in bytes; refused if it names a tag twice, for such tags would share a key."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in vocab.columns), F.lit(0))
    tags = vocab.groupBy("category", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    most, total = tags.agg(F.max("n"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if (most or 0) > 1:
        raise InvalidRowError("the vocabulary names a tag of a category more than once")
    return total


def _workspace(registry: Registry, label: str | None) -> str:
    """Folder of a run's intermediate tables; a label always has the same one."""
    if label is None:
        return new_workspace(registry.spark, "register")
    name = hashlib.sha256(f"{registry.root}\0{label}".encode()).hexdigest()
    return os.path.join(shared_dir(registry.spark), f"register-{name}")


def _found(registry: Registry, folder: str, name: str, schema: T.StructType) -> DataFrame | None:
    """A table that an earlier run of this label wrote in full."""
    path = os.path.join(folder, name)
    if not storage.exists(registry.spark, os.path.join(path, "_SUCCESS")):
        return None
    return registry.spark.read.schema(schema).parquet(path)
