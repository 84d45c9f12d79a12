"""File trees as DataFrames: listing, bytes, header facts, and the same as a stream.

Listing and reading go on inside tasks, file by file: what is wrong with one file is told in its
own row and does not end the run.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatchcase
from itertools import batched
from typing import Any, BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.images import CHAIN_PREFIX, HEADER_BYTES, CutShort, chained_size
from shelfmark.schema import FILES_PER_BATCH
from shelfmark.session import staged

# The largest content that fits into one value of a column.
MAX_CONTENT = 2**31 - 2**16
TOO_LARGE = "too large for a column"
# Bytes read at a time to hash a file.
CHUNK = 1024 * 1024

# Entries of a folder that a task holds at a time.
LISTED_AT_ONCE = 10_000

_FILE, _FOLDER, _CLOSED, _MISSING = "file", "folder", "closed", "missing"
_ENTRIES = "path string, modificationTime timestamp, length bigint, kind string"


def list_files(
    spark: SparkSession, path: str, recursive: bool = False, name_pattern: str | None = None
) -> DataFrame:
    """Every file below ``path`` as (path, modificationTime, length), whatever its name or size.

    Links are listed as files and never entered, so a link to a folder or to nothing is a file that
    cannot be read; what cannot be asked for its size has a null length. So is a folder that cannot be
    listed, or is gone by then: it has a row like a file, and whoever reads that row is told why. A path
    to one file gives that file; a missing path raises FileNotFoundError. Folders of one level are listed
    by as many tasks as a shuffle has, level by level, and in pieces of LISTED_AT_ONCE entries.
    """
    path = _plain(path)
    start = spark.createDataFrame([(path,)], "path string")
    found = _entries(start, name_pattern, root=True)
    kinds = {r.kind for r in found.where(F.col("path") == path).select("kind").collect()}
    if _MISSING in kinds:
        raise FileNotFoundError(path)
    levels = [found]
    frontier = start if _FOLDER in kinds else None
    while frontier is not None:
        level = _entries(frontier, name_pattern)
        levels.append(level)
        folders = level.where(F.col("kind") == _FOLDER).select("path")
        frontier = folders.repartition("path") if recursive and not folders.isEmpty() else None
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files.where(F.col("kind").isin(_FILE, _CLOSED)).drop("kind")


def read_files(files: DataFrame) -> DataFrame:
    """Adds (content, error) to listed files: one of the two is null. A file that is too large for a
    column has an error as well."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = opener()
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                content, error = None, None
                try:
                    with open_(path) as stream:
                        content = stream.read(MAX_CONTENT + 1)
                    if len(content) > MAX_CONTENT:
                        content, error = None, TOO_LARGE
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                columns = [*batch.slice(i, 1).columns, pa.array([content], pa.binary()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "content", "error"])

    added = [T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]
    return files.mapInArrow(run, T.StructType([*files.schema.fields, *added]))


def scan_files(
    spark: SparkSession, path: str, recursive: bool = False, name_pattern: str | None = None
) -> DataFrame:
    """Listed files with their bytes: (path, modificationTime, length, content, error)."""
    return read_files(list_files(spark, path, recursive, name_pattern))


def probe_files(files: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """(path, length, hash, header, width, height, error) of listed files, of any size, after the ``kept`` columns.

    Each file is read once, in pieces, and hashed as it passes; only its first bytes leave the task,
    as header. width and height are those of JPEG and TIFF files. length is what was read.
    """
    given = files.select(*kept, "path")
    added = [
        T.StructField("length", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("header", T.BinaryType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
    schema = T.StructType([*given.schema.fields, *added])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = opener()
        for batch in batches:
            rows = [_probed(open_, path) for path in batch.column("path").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names
            )

    return given.mapInArrow(run, schema)


@dataclass(frozen=True)
class FileStream:
    """A growing folder, taken round by round and lot by lot."""

    spark: SparkSession
    path: str
    recursive: bool
    files_per_batch: int
    name_pattern: str | None

    def listing(self) -> DataFrame:
        return list_files(self.spark, self.path, self.recursive, self.name_pattern)


def file_stream(
    spark: SparkSession,
    path: str,
    recursive: bool = False,
    files_per_batch: int = FILES_PER_BATCH,
    name_pattern: str | None = None,
) -> FileStream:
    """The files of a growing folder for ``stream_register``, at most ``files_per_batch`` at a time.

    They are those of ``list_files``, whatever their names or sizes. A file comes again when its time or
    length has changed.
    """
    return FileStream(spark, path, recursive, files_per_batch, name_pattern)


def opener() -> Callable[[str], BinaryIO]:
    """Opens one file by path or URI (local, HDFS, S3, GCS) for reading, inside tasks."""
    filesystems: dict[str, fs.FileSystem] = {}

    def open_(path: str) -> Any:
        path = _plain(path)
        if "://" not in path:
            return open(path, "rb")
        system, inner = _remote(path, filesystems)
        return system.open_input_stream(inner)

    return open_


def read_by_path() -> Callable[[str], bytes]:
    """Reader of one whole file by path or URI."""
    open_ = opener()

    def read(path: str) -> bytes:
        with open_(path) as stream:
            return stream.read()

    return read


def _plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _remote(path: str, filesystems: dict[str, fs.FileSystem]) -> tuple[fs.FileSystem, str]:
    scheme, rest = path.split("://", 1)
    root = f"{scheme}://{rest.split('/', 1)[0]}"
    if root not in filesystems:
        filesystems[root], _ = fs.FileSystem.from_uri(f"{root}/")
    _, inner = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return filesystems[root], inner


def _entries(folders: DataFrame, name_pattern: str | None, root: bool = False) -> DataFrame:
    """What the folders hold, stored; with ``root`` what the paths themselves are. Files of other names than
    the pattern's are left out where they are found."""

    def wanted(row: tuple) -> bool:
        return not name_pattern or row[3] != _FILE or fnmatchcase(row[0].rsplit("/", 1)[-1], name_pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = iter([_itself(path)]) if root else _inside(path)
                for piece in batched(filter(wanted, rows), LISTED_AT_ONCE):
                    columns = zip(*piece, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                        ["path", "modificationTime", "length", "kind"],
                    )

    return staged(folders.mapInArrow(run, _ENTRIES), "listing")


def _itself(path: str) -> tuple:
    if "://" in path:
        system, inner = _remote(path, {})
        info = system.get_file_info(inner)
        kind = {fs.FileType.File: _FILE, fs.FileType.Directory: _FOLDER}.get(info.type, _MISSING)
        return path, info.mtime, info.size, kind
    try:
        facts = os.stat(path)
    except OSError:
        return path, None, None, _MISSING
    return (path, *_facts(facts), _FOLDER if stat.S_ISDIR(facts.st_mode) else _FILE)


def _facts(found: os.stat_result) -> tuple:
    return datetime.fromtimestamp(found.st_mtime, UTC), found.st_size


def _inside(path: str) -> Iterator[tuple]:
    """Rows of a folder's entries, one after the other; a folder that ends early has a row of its own."""
    try:
        yield from _local_entries(path) if "://" not in path else _remote_entries(path)
    except OSError:
        yield path, None, None, _CLOSED


def _local_entries(path: str) -> Iterator[tuple]:
    with os.scandir(path) as entries:
        for entry in entries:
            try:
                facts = entry.stat(follow_symlinks=False)
                if stat.S_ISDIR(facts.st_mode):
                    yield entry.path, None, None, _FOLDER
                    continue
                if stat.S_ISLNK(facts.st_mode):
                    facts = entry.stat()
                elif not stat.S_ISREG(facts.st_mode):
                    continue  # pipes, sockets and devices hold no content
                row = _facts(facts)
            except OSError:
                row = None, None
            yield entry.path, *row, _FILE


def _remote_entries(path: str) -> Iterator[tuple]:
    system, inner = _remote(path, {})
    for info in system.get_file_info(fs.FileSelector(inner)):
        kind = _FOLDER if info.type == fs.FileType.Directory else _FILE
        yield f"{path.rstrip('/')}/{info.base_name}", info.mtime, info.size, kind


def _probed(open_: Callable[[str], BinaryIO], path: str) -> tuple:
    digest, length, start, header = hashlib.sha256(), 0, bytearray(), b""
    size, wanted = None, CHAIN_PREFIX  # bytes to have before the header is tried (again)
    try:
        with open_(path) as stream:
            while piece := bytes(stream.read(CHUNK)):
                digest.update(piece)
                length += len(piece)
                header = (header + piece[:HEADER_BYTES])[:HEADER_BYTES]
                if wanted is not None:
                    start += piece
                    if len(start) >= wanted:
                        size, wanted = _tried(start, wanted)
        if wanted is not None:
            size, _ = _tried(start, wanted)
    except Exception as problem:
        return None, None, None, None, None, f"{type(problem).__name__}: {problem}"
    width, height = size or (None, None)
    return length, digest.hexdigest(), header, width, height, None


def _tried(start: bytearray, wanted: int) -> tuple[tuple[int, int] | None, int | None]:
    """The size if the bytes tell it; else the number of bytes to try with next, unless no more help."""
    try:
        return chained_size(bytes(start)), None
    except CutShort:
        return None, 8 * wanted

