"""Token counts with a whole-token shortcut, for SentencePiece BPE models.

A pre-token is a stretch of normalised text that no merge ever leaves. Which strings of the vocabulary
are encoded alone as one token is proved once, from the model, before any text is read; pre-tokens that
are such strings count one each, and only the rest goes through the library's merges.

The cuts are proved from the model too. The space mark stands behind no other character in any piece,
so no merge spans the place before a mark that follows another character. A character that no piece
joins to another never merges, so there are borders on both sides of it (white space such as a line
break is tested for this). Merges on one side of such a border never depend on the other side: the
counts of pre-tokens add up to the count of the text. Models for which this does not hold (another
algorithm, a character map, trimmed spaces, symbols set by the user, marks inside of pieces) get no
cuts, and their texts are merged whole.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from shelfmark.llm.common import free_name, slices

MARK = "▁"
LIMIT = 4096
# White space and controls that may prove to stand alone.
LONERS = "\t\n\x0b\x0c\r"
SLICE_BYTES = 4 * 1024 * 1024
# Characters whose pre-tokens are listed at a time.
PART_CHARS = 256 * 1024
# Counts in a generation that a worker remembers beside the proved strings, and the longest of them.
REMEMBERED = 400_000
REMEMBERED_CHARS = 64
_BPE = 2
_NORMAL, _CONTROL, _USER, _BYTE = 1, 3, 4, 6


@dataclasses.dataclass(frozen=True)
class Proof:
    """What is known from the model alone. ``loners``: characters that never merge. ``whole``: pre-tokens
    that are one token, spaces in place of marks. No cuts at all if ``cuts`` is false."""

    cuts: bool
    loners: str
    whole: frozenset[str]


@functools.lru_cache(maxsize=4)
def prove(model: bytes) -> Proof:
    """Read the vocabulary once: may texts be cut, and which of its strings are one token alone."""
    proto = model_pb2.ModelProto.FromString(model)
    rules, pieces = proto.normalizer_spec, [p.piece for p in proto.pieces if p.type == _NORMAL]
    cuts = (
        proto.trainer_spec.model_type == _BPE
        and rules.add_dummy_prefix and rules.escape_whitespaces
        and not (rules.precompiled_charsmap or rules.remove_extra_whitespaces)
        and not proto.trainer_spec.treat_whitespace_as_suffix
        and not any(p.type == _USER for p in proto.pieces)
        and (proto.trainer_spec.byte_fallback and sum(p.type == _BYTE for p in proto.pieces) == 256)
        and MARK in pieces
        and not any(MARK in p.lstrip(MARK) for p in pieces)
        and len(set(LONERS) - {c for p in pieces if len(p) > 1 for c in p}) > 0
    )
    if not cuts:
        return Proof(False, "", frozenset())
    joined = {c for p in pieces if len(p) > 1 for c in p}
    loners = "".join(c for c in LONERS if c not in joined)
    counter = Counter(model, Proof(True, loners, frozenset()))
    found = [p.replace(MARK, " ") for p in pieces]
    pre_tokens = [p for p in found if p != " " and counter.cut.findall(p) == [p] and (p.startswith(" ") or loners)]
    counts = counter.merged(pre_tokens)
    return Proof(True, loners, frozenset(p for p, n in zip(pre_tokens, counts, strict=True) if n == 1))


class Remembered(dict):
    """Counts by string: what is proved, and two generations of bounded size of what had to be merged.

    A string that is not known counts zero for now and is set down, to be merged with others at once."""

    def __init__(self, proved: dict[str, int]):
        super().__init__(proved)
        self.proved, self.older, self.open = proved, {}, []

    def __missing__(self, key: str) -> int:
        count = self.older.get(key)
        if count is None:
            self.open.append(key)
            return 0
        self.keep(key, count)
        return count

    def keep(self, key: str, count: int) -> None:
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= len(self.proved) + REMEMBERED:
                self.older = dict(self)
                self.clear()
                self.update(self.proved)
            self[key] = count


class Counter:
    """Counts the tokens of texts: proved strings by a look-up, the rest by the library."""

    def __init__(self, model: bytes, proof: Proof):
        self.proof = proof
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        loners = re.escape(proof.loners)
        # spaces with what follows them, text without spaces before it, or one loner
        self.cut = re.compile(f" +[^ {loners}]*|[^ {loners}]+" + (f"|[{loners}]" if loners else ""))
        self.border = re.compile("(?<=[^ ]) ")
        self.quick = "\n" in proof.loners
        others = re.escape(proof.loners.replace("\n", ""))
        self.slow = re.compile("  " + (f"|[{others}]" if others else ""))
        # one space alone is what the library makes of no text at all
        self.pieces = Remembered({**dict.fromkeys(proof.whole, 1), " ": 1})
        words = {p[1:]: 1 for p in proof.whole if p.startswith(" ") and not p.startswith("  ")}
        self.words = Remembered({**words, "": 1})

    def merged(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token, by the library, whose own prefix stands for a first space. Elsewhere
        the prefix is one token more: it stands before a loner, one that is set there if need be."""
        texts, more = [], []
        for piece in pieces:
            own = piece.startswith(" ")
            alone = own or piece[:1] in self.proof.loners
            texts.append(piece[1:] if own else piece if alone else self.proof.loners[0] + piece)
            more.append(0 if own else 1 if alone else 2)
        found = self.processor.encode(texts, num_threads=1)
        return [len(ids) - n for ids, n in zip(found, more, strict=True)]

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        if not self.proof.cuts:
            return len(self.processor.encode(text))
        return sum(map(self._part, self.parts(text)))

    def _part(self, part: str) -> int:
        if not self.quick or self.slow.search(part):
            return self._total(self.pieces, self.cut.findall(part), "")
        # every space is alone: what lies between two is a pre-token, or a line break and one behind it
        return self._total(self.words, part[1:].replace("\n", " \n").split(" "), " ")

    def _total(self, known: Remembered, strings: list[str], before: str) -> int:
        total = sum(map(known.__getitem__, strings))
        if known.open:
            counts = self.merged([x if x[0] == "\n" else before + x for x in known.open])
            for string, count in zip(known.open, counts, strict=True):
                known.keep(string, count)
            known.open.clear()
            total += sum(counts)
        return total

    def parts(self, text: str) -> Iterator[str]:
        """The text with its prefix, in parts that end on borders and begin with a space."""
        text = " " + text.replace(MARK, " ")
        start = 0
        while start < len(text):
            border = self.border.search(text, start + PART_CHARS)
            end = border.start() if border else len(text)
            yield text[start:end]
            start = end


@functools.lru_cache(maxsize=1)
def _counter(model: bytes, proof: Proof) -> Counter:
    return Counter(model, proof)


def count_tokens(docs: DataFrame, model: bytes, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each document: the whole text, without begin and end ids.

    n_tokens is what the library counts. Null and empty texts have no bytes and no tokens. The result
    depends on the text alone, so repeated rows give repeated results, rows without doc_id included. Long
    texts are listed in parts. An empty table gives an empty result; other columns are left out, whatever
    their names. ``model`` is the file's content, so executors need not see the file.
    """
    proof = prove(model)
    size = free_name(docs.select("doc_id", "text"), "n_bytes")
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model, proof)
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            counts = [counter.tokens(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column(size), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    counted = sized.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
