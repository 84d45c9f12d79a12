"""User-supplied Python over partitions: the batch scorer and a plain parallel map.

Columns pass through as Arrow, untouched by Python, so no type changes on the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.sources.files import read_by_path

# A scorer takes the bytes of a few files and gives, for each, its score vector; None or an
# exception instead of a vector marks that file as failed. One with a method ``close`` is closed
# when another takes its place.
Scorer = Callable[[Sequence[bytes]], Sequence[Any]]
ScorerFactory = Callable[[], Scorer]

POSITIONS = T.StructField("positions", T.ArrayType(T.IntegerType()))
SCORES = T.StructField("scores", T.ArrayType(T.FloatType()))
ERROR = T.StructField("error", T.StringType())

_loaded: dict[str, Scorer] = {}


def scorer_key(factory: ScorerFactory) -> str:
    """The same for every call with the same factory, so that workers keep what they have loaded."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _load_once(key: str, factory: ScorerFactory) -> Scorer:
    """The one scorer of this Python worker: set up once, then shared by all tasks and calls."""
    if key not in _loaded:
        for old in _loaded.values():
            getattr(old, "close", lambda: None)()
        _loaded.clear()
        _loaded[key] = factory()
    return _loaded[key]


def _error_text(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"


def _score_batch(scorer: Scorer, contents: Sequence[bytes]) -> list[Any]:
    """Scores or errors, one per file. When a batch fails, its files are tried one by one."""
    try:
        results = list(scorer(contents))
        if len(results) != len(contents):
            raise ValueError(f"scorer gave {len(results)} results for {len(contents)} files")
        return results
    except Exception as error:
        if len(contents) == 1:
            return [error]
        return [result for content in contents for result in _score_batch(scorer, [content])]


def _passing(vector: Any, threshold: float) -> tuple[Any, Any]:
    """Positions and values at or above the threshold, compared as 32-bit floats."""
    if vector is None:
        return None, None
    values = np.asarray(vector, dtype=np.float32)
    positions = np.flatnonzero(values >= np.float32(threshold)).astype(np.int32)
    return positions, values[positions]


def _read_all(read: Callable[[str], bytes], paths: Sequence[str]) -> list[Any]:
    contents: list[Any] = []
    for path in paths:
        try:
            contents.append(read(path))
        except Exception as error:
            contents.append(error)
    return contents


def _chunks(
    batches: Iterator[pa.RecordBatch], rows: int, given: Callable[[pa.RecordBatch], list[Any]]
) -> Iterator[tuple[pa.RecordBatch, list[Any]]]:
    """Pieces of the batches with their contents; the next contents are read while one is in use."""
    with ThreadPoolExecutor(1) as ahead:
        waiting = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                following = piece, ahead.submit(given, piece)
                if waiting:
                    yield waiting[0], waiting[1].result()
                waiting = following
        if waiting:
            yield waiting[0], waiting[1].result()


def score_assets(
    df: DataFrame,
    factory: ScorerFactory,
    content: str | None = "content",
    path: str = "path",
    threshold: float | None = None,
    batch_rows: int = 32,
    reader: Callable[[], Callable[[str], bytes]] = read_by_path,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Replace the bytes by (scores, error).

    With ``content=None`` the tasks read each file by its ``path``, ``batch_rows`` at a time and one
    such piece ahead of the scorer: the bytes then never pass through a shuffle or an Arrow batch.
    Errors are kept per file.

    With a ``threshold`` only the scores that reach it leave the worker, with their positions in
    ``positions``: a vector over a large vocabulary shrinks to the few tags it gives.

    With a resource ``profile`` the stage that scores runs on executors that have what it asks for, such
    as a GPU for each task; scanning and storing keep the session's own.
    """
    kept = [f for f in df.schema.fields if f.name != content]
    names = [f.name for f in kept]
    key = scorer_key(factory)
    floats, places = pa.list_(pa.float32()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _load_once(key, factory)
        read = reader() if content is None else None

        def given(piece: pa.RecordBatch) -> list[Any]:
            if read is None:
                return piece.column(content).to_pylist()
            return _read_all(read, piece.column(path).to_pylist())

        for piece, contents in _chunks(batches, batch_rows, given):
            readable = [i for i, c in enumerate(contents) if isinstance(c, bytes | bytearray)]
            results = [c if isinstance(c, Exception) else None for c in contents]
            if readable:
                scored = _score_batch(scorer, [contents[i] for i in readable])
                for i, result in zip(readable, scored, strict=True):
                    results[i] = result
            failed = [r is None or isinstance(r, Exception) for r in results]
            vectors = [None if f else np.asarray(r, np.float32) for r, f in zip(results, failed, strict=True)]
            if threshold is None:
                added = [pa.array(vectors, floats)]
            else:
                passing = [_passing(v, threshold) for v in vectors]
                added = [pa.array([p for p, _ in passing], places), pa.array([s for _, s in passing], floats)]
            errors = [
                (_error_text(r) if r is not None else "no result") if f else None
                for r, f in zip(results, failed, strict=True)
            ]
            columns = [*(piece.column(n) for n in names), *added, pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, out)

    vector = [SCORES] if threshold is None else [POSITIONS, SCORES]
    schema = T.StructType([*kept, *vector, ERROR])
    out = schema.names
    return df.mapInArrow(run, schema, profile=profile)


def parallel_map(
    df: DataFrame,
    func: Callable[..., Any],
    result_type: T.DataType,
    args: Sequence[str] = (),
    kwargs: Sequence[str] = (),
    on_error: str = "capture",
) -> DataFrame:
    """Call ``func`` once per row and add (value, error).

    ``args`` and ``kwargs`` name the columns passed by position and by name, as plain Python values
    with None for null. ``capture`` keeps an exception in ``error`` and goes on; ``raise`` fails the
    job on the first one.
    """
    if not args and not kwargs:
        raise ValueError("args or kwargs must name at least one column")
    if on_error not in ("capture", "raise"):
        raise ValueError(f"on_error must be 'capture' or 'raise', not {on_error!r}")
    args, kwargs = list(args), list(kwargs)

    def call(positional: tuple, named: dict[str, Any]) -> tuple[Any, str | None]:
        try:
            return func(*positional, **named), None
        except Exception as error:
            if on_error == "raise":
                raise
            return None, _error_text(error)

    added = [T.StructField("value", result_type), T.StructField("error", T.StringType())]
    schema = T.StructType([*df.schema.fields, *added])
    names, value_type = schema.names, to_arrow_type(result_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(c).to_pylist(maps_as_pydicts="strict") for c in {*args, *kwargs}}
            results = [
                call(tuple(values[a][i] for a in args), {k: values[k][i] for k in kwargs})
                for i in range(batch.num_rows)
            ]
            columns = [
                *batch.columns,
                pa.array([v for v, _ in results], value_type),
                pa.array([e for _, e in results], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)
