"""Registration of a growing folder with Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.dedup import HASH_ROW_BYTES
from shelfmark.operators.joins import MAX_BROADCAST_BYTES
from shelfmark.operators.scoring import ScorerFactory
from shelfmark.plans.register import Registration, register, register_lots
from shelfmark.registry import Registry, State
from shelfmark.schema import DEFAULT_THRESHOLD
from shelfmark.sources.files import FileStream, read_files
from shelfmark.streaming.hash_state import HashState
from shelfmark.streaming.rounds import Position, Rounds

# Seconds between two listings of a folder.
INTERVAL = 10
# Parts of a table after which a stream merges them.
MAX_PARTS = 200


def stream_register(
    registry: Registry,
    files: DataFrame | FileStream,
    scorer: ScorerFactory,
    vocab: DataFrame,
    checkpoint: str,
    *,
    name: str = "files",
    threshold: float = DEFAULT_THRESHOLD,
    on_duplicate: str = "keep_first",
    content: str | None = None,
    on_batch: Callable[[int, Registration], None] | None = None,
    available_now: bool = True,
    profile: ResourceProfile | None = None,
    state_from_bytes: int = MAX_BROADCAST_BYTES,
) -> StreamingQuery:
    """Register each micro-batch of a file stream before the next one starts.

    A micro-batch sees what earlier ones stored. Its commit carries ``name`` and its number, so
    one that runs again after a failure changes nothing. ``on_batch`` is told the number and the
    result of each; its tables of metadata and outcomes are removed after that.

    A ``file_stream`` is listed in every micro-batch as in a batch run, so every file is registered or told
    as skipped. What it has new, or changed, goes through in lots of bounded size, each a commit of its
    own; ``on_batch`` is called for each lot, with its position in the result. Lots of small files are read, scored
    and written together, see ``rounds``, with the same tables as one by one. Files that could not be read
    or scored come again in the next micro-batches, a bounded number of times. Other streams are Spark's.
    Tables of many parts are merged on the way. A resource ``profile`` is for the scorer, as in ``register``.

    Micro-batches are checked against the registry's hashes by a broadcast as long as these have at most
    ``state_from_bytes``, and beyond that against Spark's state store, which has one mark for each of them below
    ``checkpoint``: a micro-batch then reads no more of a larger registry. Take the RocksDB store for that.
    """
    hashes = HashState(registry, os.path.join(checkpoint, "hashes"))

    def run(batch: DataFrame, number: int, label: str, position: Position | None = None) -> Registration:
        result = register(
            registry,
            batch,
            scorer,
            vocab,
            threshold=threshold,
            on_duplicate=on_duplicate,
            content=content,
            label=f"{name}:{label}",
            profile=profile,
            unknown=ask(registry.state()),
        )
        result = replace(result, position=position)
        if on_batch:
            on_batch(number, result)
        _merge_parts(registry)
        return result

    def ask(state: State) -> Callable[[DataFrame, State], DataFrame] | None:
        return hashes.unknown if state.rows("images") * HASH_ROW_BYTES > state_from_bytes else None

    def together(
        files: DataFrame, lots: Sequence[tuple[Position, str]], known: str, settle: Callable[[int, DataFrame], None]
    ) -> Iterator[tuple[Position, Registration]]:
        positions = {position.number: position for position, _ in lots}
        labels = [(position.number, f"{name}:{label}") for position, label in lots]
        results = register_lots(
            registry, files, labels, scorer, vocab, name=f"{name}:{known}", threshold=threshold, profile=profile,
            unknown=ask, settle=settle,
        )
        for number, result in results:
            result = replace(result, position=positions[number])
            if on_batch:
                on_batch(number, result)
            yield positions[number], result
        _merge_parts(registry)

    def lot(paths: DataFrame, position: Position, label: str) -> Registration:
        return run(paths if content is None else read_files(paths), position.number, label, position)

    if isinstance(files, FileStream):
        clock = registry.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        # a lot that holds copies is refused alone, and bytes are read for one lot at a time
        many = together if content is None and on_duplicate == "keep_first" else None
        writer = clock.writeStream.foreachBatch(Rounds(files, lot, checkpoint, many).__call__)
    else:
        writer = files.writeStream.foreachBatch(lambda batch, number: run(batch, number, str(number)).release())
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif isinstance(files, FileStream):
        writer = writer.trigger(processingTime=f"{INTERVAL} seconds")
    return writer.start()


def _merge_parts(registry: Registry) -> None:
    parts = [part.table for part in registry.state().parts]
    for table in ("images", "model_tags"):
        if parts.count(table) > MAX_PARTS:
            registry.compact(table)
