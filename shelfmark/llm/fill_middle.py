"""Fill-in-the-middle: texts are cut at two unit borders, and the middle goes to the end.

A unit is white space with the word behind it; white space at the end of a text is one too. A text is
looked at in blocks of fixed size, and for each block the units that end in it and the code points that
begin in it are counted. Two Fenwick trees hold these counts. A cut after so many units is found by a
binary-lifting descent, which gives its block and both counts before the block; only that block is then
looked at unit by unit.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, free_name, slices, texts_of

SEED = 42
# Percent of texts that are cut, and percent of these whose suffix comes first.
CUT_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 4096
SLICE_BYTES = 8 * 1024 * 1024
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True


class Fenwick:
    """Prefix sums over blocks: tree[i] holds the sum of the blocks whose last one is i."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.arange(1, self.size + 1)
        self.tree = np.concatenate([[0], sums[ends] - sums[ends - (ends & -ends)]]).tolist()


def descend(units: Fenwick, chars: Fenwick, wanted: int) -> tuple[int, int, int]:
    """The block in which the wanted unit (from 1) ends, with the units and code points before the block."""
    block, passed, points = 0, 0, 0
    step = 1 << (units.size.bit_length() - 1)
    while step:
        ahead = block + step
        if ahead <= units.size and passed + units.tree[ahead] < wanted:
            block = ahead
            passed += units.tree[ahead]
            points += chars.tree[ahead]
        step >>= 1
    return block, passed, points


class BlockedText:
    """A text as UTF-8 with the counts of its blocks."""

    def __init__(self, text: bytes):
        self.raw = np.frombuffer(text, np.uint8)
        blocks = max(1, -(-len(text) // BLOCK_BYTES))
        units, chars = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
        for i in range(blocks):
            units[i] = np.count_nonzero(self._ends(i))
            chars[i] = np.count_nonzero(self._heads(i))
        self.n_units, self.n_chars = int(units.sum()), int(chars.sum())
        self.units, self.chars = Fenwick(units), Fenwick(chars)

    def _ends(self, block: int) -> np.ndarray:
        """For each byte of a block whether a unit ends with it: the next one is white space and it is not,
        or the text ends."""
        start = block * BLOCK_BYTES
        space = _SPACE[self.raw[start : start + BLOCK_BYTES + 1]]
        ends = ~space[:-1] & space[1:]
        if start + BLOCK_BYTES >= len(self.raw):
            ends = np.append(ends, len(space) > 0)[: len(space)]
        return ends

    def _heads(self, block: int) -> np.ndarray:
        """For each byte of a block whether a code point begins with it."""
        start = block * BLOCK_BYTES
        return (self.raw[start : start + BLOCK_BYTES] & 0xC0) != 0x80

    def cut(self, wanted: int) -> tuple[int, int]:
        """Bytes and code points of the first so many units."""
        if not wanted:
            return 0, 0
        block, passed, points = descend(self.units, self.chars, wanted)
        inside = int(np.flatnonzero(self._ends(block))[wanted - passed - 1]) + 1
        return block * BLOCK_BYTES + inside, points + int(np.count_nonzero(self._heads(block)[:inside]))


@dataclasses.dataclass(frozen=True)
class Rule:
    """Seed, and the shares of forms in percent."""

    seed: int = SEED
    cut_percent: int = CUT_PERCENT
    spm_percent: int = SPM_PERCENT

    def draws(self, key: str) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]

    def moved(self, text: bytes, key: str) -> tuple[int, str, int | None, int | None, bytes]:
        """(units, form, prefix_chars, middle_chars, output) of a text."""
        blocked = BlockedText(text)
        one, other, share, form = self.draws(key)
        if not text or share % 100 >= self.cut_percent or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
            return blocked.n_units, "plain", None, None, text
        low, high = sorted((one % (blocked.n_units + 1), other % (blocked.n_units + 1)))
        (start, before), (end, upto) = blocked.cut(low), blocked.cut(high)
        named = {
            "P": PREFIX.encode() + text[:start], "M": MIDDLE.encode() + text[start:end], "S": SUFFIX.encode() + text[end:],
        }
        kind, order = ("spm", "SPM") if form % 100 < self.spm_percent else ("psm", "PSM")
        return blocked.n_units, kind, before, upto - before, b"".join(named[part] for part in order)


def fill_middle(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each document: the whole text.

    n counts units. Cuts and form are drawn from a hash of seed and doc_id; rows without doc_id are drawn
    by the SHA-256 of their text. Null counts as empty. Empty texts and those that hold one of the marks
    stay plain, with null for both counts of characters. Repeated rows give repeated results; long texts
    are looked at block by block; an empty table gives an empty result; other columns are left out,
    whatever their names.
    """
    key = free_name(docs.select("doc_id", "text"), "draw_key")
    named = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            rows = map(rule.moved, texts_of(batch), batch.column(key).to_pylist())
            n, form, prefix, middle, output = zip(*rows, strict=True)
            columns = [
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text", named.alias(key)).mapInArrow(run, schema)


def restored(moved: DataFrame, column: str = "restored") -> DataFrame:
    """Adds the text that output and form stand for. No mark can arise where a part and a mark meet, since each
    mark has its only < in front. A column named like the new one is replaced."""
    parts = F.split("output", "|".join((PREFIX, SUFFIX, MIDDLE)))
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    text = F.when(F.col("form") == "psm", F.concat(first, third, second)).when(
        F.col("form") == "spm", F.concat(second, third, first)
    )
    return moved.withColumn(column, text.otherwise(F.col("output")))
