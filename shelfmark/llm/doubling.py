"""Substring dedup by level-wise doubling.

A window of words can only repeat if its halves do. Short windows are looked up first, for all documents
at once; only those found in two documents are extended to twice the length and looked up again, level by
level, until the full length is reached or no candidates survive. Below the full length one window stands
for each stretch of the next length, the one with the least hash, which is the same wherever the stretch
occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfmark.session import empty_table, new_workspace, staged

WINDOW_WORDS = 13
# The first level has at most so many words: shorter windows repeat in nearly all texts.
BASE_WORDS = 9
LAST_ID = 2**63 - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, length: int, step: np.uint64 = _STEP) -> np.ndarray:
    """A hash for each run of so many words."""
    total = np.zeros(max(len(words) - length + 1, 0), np.uint64)
    for i in range(length):
        total = total * step + words[i : i + len(total)]
    total ^= total >> np.uint64(29)
    total *= _MIX
    return total ^ (total >> np.uint64(32))


def levels(window: int) -> list[int]:
    """Lengths from the first level to the full one, each at most twice the one before."""
    found = [window]
    while found[0] > BASE_WORDS:
        found.insert(0, -(-found[0] // 2))
    return found if len(found) > 1 else [window, window]


def anchors(words: np.ndarray, short: int, length: int) -> np.ndarray:
    """For each window of ``length`` words, the least hash of the short windows in it."""
    return _least(window_hashes(words, short), length - short)


def _least(values: np.ndarray, further: int) -> np.ndarray:
    """For each place the least of its value and so many further ones."""
    n = max(len(values) - further, 0)
    least = values[:n].copy()
    for i in range(1, further + 1):
        np.minimum(least, values[i : i + n], out=least)
    return least


def covered(starts: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the marked places."""
    change = np.zeros(n_words + 1, np.int64)
    places = np.flatnonzero(starts)
    np.add.at(change, places, 1)
    np.add.at(change, places + length, -1)
    return np.cumsum(change[:-1]) > 0


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").tobytes()


# id and text name a document; others are the further texts of that id for which the row stands.
SCHEMA = "h bigint, g int, id bigint, text_key bigint, others array<bigint>, pack binary"


def _rows(hashes: list, checks: list, ids: list, keys: list, others: list, packs: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    columns = zip((hashes, checks, ids, keys, others, packs), kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], [f.split()[0] for f in SCHEMA.split(", ")])


def _level(found: Iterator[tuple[int, int, np.ndarray, np.ndarray]], first_only: bool) -> pa.RecordBatch | None:
    """What one batch tells of a level, from (id, key of the text, distinct hashes, their second hashes) of each
    document.

    Each hash leaves the batch once, with the least id that holds it, for all texts of that id. What the
    batch alone decides goes out packed, in one row for each document: hashes that another document of the
    batch shares or, with ``first_only``, that one of a smaller id does.
    """
    ids, keys, hashes, checks = [], [], [], []
    for number, key, values, other in found:
        ids.append(np.full(len(values), number, np.int64))
        keys.append(np.full(len(values), key, np.int64))
        hashes.append(values)
        checks.append(other)
    if not ids:
        return None
    ids, keys, hashes, checks = (np.concatenate(x) for x in (ids, keys, hashes, checks))
    order = np.lexsort((keys, ids, checks, hashes))
    ids, keys, hashes, checks = ids[order], keys[order], hashes[order], checks[order]
    new = np.ones(len(ids), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    group = np.cumsum(new) - 1
    least = ids[new][group]
    decided = ids != least
    if not first_only:
        shared = np.zeros(len(least) and group[-1] + 1, bool)
        shared[group[decided]] = True
        decided = shared[group]
    alone = new & ~decided if not first_only else new
    # a decided hash is still told to the other batches, without a document of its own
    told = new & ~alone
    packed, packs = [], []
    places = np.flatnonzero(decided)
    places = places[np.lexsort((keys[places], ids[places]))]
    ends = (np.diff(ids[places]) != 0) | (np.diff(keys[places]) != 0)
    for part in np.split(places, np.flatnonzero(ends) + 1):
        if len(part):
            packed.append(part[0])
            packs.append(_packed(hashes[part]))
    single, tell, packed = np.flatnonzero(alone), np.flatnonzero(told), np.array(packed, np.int64)
    # further texts of the id that holds a hash alone
    others: dict[int, list[int]] = {}
    for i in np.flatnonzero(~new & ~decided):
        others.setdefault(int(group[i]), []).append(int(keys[i]))
    listed = [others.get(g) for g in group[single].tolist()] if others else [None] * len(single)
    rows = np.concatenate([single, tell, packed])
    n_told, n_packed = [None] * len(tell), [None] * len(packed)
    return _rows(
        hashes[rows].view(np.int64), checks[rows].view(np.int32),
        [*ids[single].tolist(), *n_told, *ids[packed].tolist()], [*keys[single].tolist(), *n_told, *keys[packed].tolist()],
        [*listed, *n_told, *n_packed], [None] * (len(single) + len(tell)) + packs,
    )


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, tuple[int, int]]]:
    """(row, word hashes, (id, key of the text)) of the documents that are no copies."""
    columns = (batch.column(c).to_pylist() for c in ("text", "id", "text_key", "copy"))
    for i, (text, number, key, copy) in enumerate(zip(*columns, strict=True)):
        if copy:
            continue
        words = (text or "").encode().split()
        yield i, word_hashes(words), (number, key)


def _distinct(values: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, first = np.unique(values, return_index=True)
    return found, np.zeros(len(found), np.uint32) if other is None else other[first]


def _by_document(judged: DataFrame) -> DataFrame:
    """(id, text_key, single hashes, packed hashes) for each document; packed rows stand for their packed hashes
    alone. Rows that repeat id and text have the same hashes, which are kept once."""
    keys = F.explode(F.concat(F.array("text_key"), F.coalesce("others", F.array().cast("array<bigint>"))))
    own = judged.select("id", keys.alias("text_key"), F.when(F.col("pack").isNull(), F.col("h")).alias("h"), "pack")
    return own.groupBy("id", "text_key").agg(F.collect_set("h").alias("singles"), F.collect_set("pack").alias("packs"))


def _known(singles: list | None, packs: list | None) -> np.ndarray:
    parts = [np.array(singles or [], np.int64).view(np.uint64)]
    parts += [np.frombuffer(p, "<u8") for p in packs or []]
    return np.concatenate(parts)


def drop_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each document, repeated rows included.

    A word goes if a window that covers it also starts in a document of smaller doc_id; kept are the
    other words, joined by a space. Null texts have no words. Rows that share a doc_id do not
    remove from each other; rows without doc_id come after all others, and do not remove from each other
    either. Copies of a whole text are settled by its hash alone; the windows of the others go through the
    levels. Hashes of a document are regrouped by doc_id and, where several rows share that, by text, so rows
    without doc_id are as many groups as they have texts. A text is hashed as a whole by one task, however long. An empty table gives an
    empty result; other columns are left out, whatever their names.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    text_hash = F.xxhash64("text").alias("t1")
    marks = docs.select(number.alias("id"), text_hash, F.xxhash64(F.lit(1), "text").alias("t2"))
    found = marks.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    least = staged(found.where("n > 1"), "repeat-copies")
    copies = staged(marks.join(least, ["t1", "t2"]).where("id > least").select("id", "t1").distinct(), "repeat-copied")
    # ids of several rows, the lack of one included: only there a document is named by its text as well
    shared = staged(marks.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("shared")), "repeat-ids")
    table = f"repeat_texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    (
        docs.select("doc_id", "text", number.alias("id"), text_hash).join(shared, "id", "left")
        .join(copies.withColumn("copy", F.lit(True)), ["id", "t1"], "left")
        .withColumn("text_key", F.when(F.col("shared"), F.col("t1")).otherwise(0))
        .select("id", "text_key", "doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"))
        .write.bucketBy(parts, "id", "text_key").option("compression", "zstd")
        .option("path", new_workspace(spark, "repeat-texts")).saveAsTable(table)
    )
    texts = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone; the frame keeps the files and their buckets

    def step(lengths: list[int], i: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """What the documents tell of level i: windows that stand for a stretch of the next length, all of whose
        windows may still repeat; at the full length these windows themselves."""

        def alive(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
            columns = [batch.column(c).to_pylist() for c in ("singles", "packs")] if i else None
            for row, words, name in _texts(batch):
                if columns is None:
                    yield name, words, np.ones(max(len(words) - lengths[0] + 1, 0), bool)
                else:
                    known = _known(columns[0][row], columns[1][row])
                    yield name, words, np.isin(anchors(words, lengths[i - 1], lengths[i]), known)

        def found(batch: pa.RecordBatch) -> Iterator[tuple]:
            for name, words, open_ in alive(batch):
                if i == len(lengths) - 1:
                    other = (window_hashes(words, window, _OTHER)[open_] >> np.uint64(32)).astype(np.uint32)
                    yield *name, *_distinct(window_hashes(words, window)[open_], other)
                else:
                    further = lengths[i + 1] - lengths[i]
                    whole = ~(_least(open_.astype(np.uint8), further) == 0)
                    yield *name, *_distinct(_least(window_hashes(words, lengths[i]), further)[whole])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = _level(found(batch), i == len(lengths) - 1)
                if out is not None:
                    yield out

        return run

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "copy", "singles", "packs"))
            for text, copy, singles, packs in zip(*columns, strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words), bool)
                if copy:
                    gone[:] = len(words) >= window
                elif singles or packs:
                    starts = np.isin(window_hashes(word_hashes(words), window), _known(singles, packs))
                    gone = covered(starts, len(words), window)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            numbers = pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    open_ = texts.where("NOT copy").select("id", "text_key", "text", "copy")
    lengths, same_short = levels(window), Window.partitionBy("h")
    told = open_.mapInArrow(step(lengths, 0), SCHEMA)
    for i in range(1, len(lengths)):
        repeated = told.withColumn("n", F.count(F.lit(1)).over(same_short)).where(
            "id IS NOT NULL AND (pack IS NOT NULL OR n > 1)"
        )
        candidates = _by_document(repeated)
        if i < len(lengths) - 1:
            candidates = staged(candidates, "repeat-candidates")
            if candidates.isEmpty():  # then no longer window repeats either
                told = empty_table(spark, told.schema)
                break
        told = open_.join(candidates, ["id", "text_key"]).mapInArrow(step(lengths, i), SCHEMA)
    fulls = staged(told, "repeat-full")
    same = Window.partitionBy("h", "g")
    later = fulls.withColumn("least", F.min("id").over(same)).where("pack IS NOT NULL OR id > least")
    verdicts = _by_document(later)
    return (
        texts.join(verdicts, ["id", "text_key"], "left").select("doc_id", "text", "copy", "singles", "packs")
        .mapInArrow(remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
    )
