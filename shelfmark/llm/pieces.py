"""SentencePiece encoding that keeps offsets, and decoding.

Texts are normalised here as the model asks: at each place the longest prefix found in the model's
compiled character map is replaced, and every normalised byte remembers the source bytes it came
from. The library's merges cut the normalised text; each piece is then projected through that
record to a span of source bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from shelfmark.llm.common import slices, texts_of

SPACE = "▁".encode()
# Text and ids handled at a time: lists of ids take many times the memory of their text.
SLICE_BYTES = 1024 * 1024
SLICE_IDS = 512 * 1024
_BYTE, _CONTROL, _USER = 6, 3, 4


class CharsMap:
    """The model's compiled map: a double-array trie from byte strings to their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, start: int) -> tuple[bytes, int] | None:
        """Replacement of the longest known prefix of text[start:], and how much it covers."""
        if not self.units:
            return None
        place = self._child(0)
        best = None
        for end in range(start, len(text)):
            place ^= text[end]
            unit = self.units[place] if place < len(self.units) else 0
            if unit & 0x800000FF != text[end]:
                break
            has_value = unit >> 8 & 1
            place ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if has_value:
                best = self.units[place] & 0x7FFFFFFF, end + 1 - start
        if best is None:
            return None
        return self.pool[best[0] : self.pool.index(b"\0", best[0])], best[1]

    def _child(self, place: int) -> int:
        unit = self.units[place]
        return place ^ (unit >> 10) << ((unit & 0x200) >> 6)


class Model:
    def __init__(self, proto: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        parsed = model_pb2.ModelProto.FromString(proto)
        self.spec = parsed.normalizer_spec
        self.suffix = parsed.trainer_spec.treat_whitespace_as_suffix
        self.map = CharsMap(self.spec.precompiled_charsmap)
        self.symbols = sorted(
            (p.piece.encode() for p in parsed.pieces if p.type == _USER), key=len, reverse=True
        )
        self.lengths = np.array(
            [1 if p.type == _BYTE else 0 if p.type == _CONTROL else len(p.piece.encode()) for p in parsed.pieces],
            np.int64,
        )
        self.unknown = self.processor.unk_id()
        self.space = SPACE if self.spec.escape_whitespaces else b" "
        self.plain = not (self.map.units or self.symbols or self.spec.remove_extra_whitespaces or self.suffix)

    def normalized(self, text: bytes) -> tuple[bytes | None, np.ndarray, np.ndarray]:
        """For each byte of the normalised text, begin and end of the source bytes behind it.

        A character that stays itself is one unit. The text itself is None on the quick way, where
        nothing but spaces changes.
        """
        if not text:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.plain:
            raw = np.frombuffer(text, np.uint8)
            starts = np.flatnonzero((raw & 0xC0) != 0x80)
            ends = np.append(starts[1:], len(raw))
            width = np.where(raw[starts] == 32, len(self.space), ends - starts)
            if self.spec.add_dummy_prefix:
                starts, ends = np.append(0, starts), np.append(0, ends)
                width = np.append(len(self.space), width)
            return None, np.repeat(starts, width), np.repeat(ends, width)
        return self._mapped(text)

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        trim = self.spec.remove_extra_whitespaces
        units = []  # (normalised bytes, begin, end), spaces still plain
        place = 0
        while place < len(text):
            new, used = self._prefix(text, place)
            units.append((new, place, place + used))
            place += used
        out, begins, ends = bytearray(), [], []

        def put(piece: bytes, begin: int, end: int) -> None:
            out.extend(piece)
            begins.extend([begin] * len(piece))
            ends.extend([end] * len(piece))

        after_space = trim
        content = []
        for new, begin, end in units:
            if trim and after_space:
                new = new.lstrip(b" ")
            if new:
                content.append((new, begin, end))
                after_space = trim and new.endswith(b" ")
        while trim and content and content[-1][0].endswith(b" "):
            new, begin, end = content.pop()
            if new.rstrip(b" "):
                content.append((new.rstrip(b" "), begin, end))
        if not content:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.spec.add_dummy_prefix and not self.suffix:
            put(self.space, content[0][1], content[0][1])
        for new, begin, end in content:
            put(new.replace(b" ", self.space), begin, end)
        if self.spec.add_dummy_prefix and self.suffix:
            put(self.space, content[-1][2], content[-1][2])
        return bytes(out), np.array(begins, np.int64), np.array(ends, np.int64)

    def _prefix(self, text: bytes, place: int) -> tuple[bytes, int]:
        for symbol in self.symbols:
            if text.startswith(symbol, place):
                return symbol, len(symbol)
        found = self.map.longest(text, place)
        if found:
            return found
        end = place + 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        return text[place:end], end - place

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes [begin, end) of each piece. Begin and end ids get empty spans at the borders."""
        new, begins, ends = self.normalized(text)
        lengths = self.lengths[ids]
        if (ids == self.unknown).any():
            pieces = self.processor.encode(text.decode(), out_type=str)
            # an unknown piece covers its own text, however long; bytes and all others are as before
            for i, piece in zip(np.flatnonzero(lengths > 0), pieces, strict=True):
                if ids[i] == self.unknown:
                    lengths[i] = len(piece.encode())
        stop = np.cumsum(lengths)
        if (stop[-1] if len(stop) else 0) != len(begins):
            raise ValueError("pieces and normalised text differ in length")
        first = np.append(begins, len(text))[stop - lengths]
        last = np.where(lengths > 0, np.append(0, ends)[stop], first)
        return first, last


@functools.lru_cache(maxsize=1)
def _model(proto: bytes) -> Model:
    return Model(proto)


def encode(
    docs: DataFrame, model: bytes, begin: bool = True, end: bool = True, decoded: bool = False
) -> DataFrame:
    """(doc_id, ids, begins, ends, ids_packed) for each document: the whole text, without sampling.

    With ``decoded`` the text that the ids decode to is added in the same pass, so that long lists
    of ids need not cross to Python again.

    begins and ends are offsets into the UTF-8 text; ids_packed holds the ids as little-endian
    unsigned 32-bit integers. Null counts as empty and has only the begin and end ids. The result
    depends on the text alone, so repeated rows give repeated results, and rows without doc_id count like
    others. An empty table gives an empty result; other columns are left out. ``model`` is the file's
    content, so executors need not see the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _model(model)
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            texts = texts_of(batch)
            found = loaded.processor.encode(
                [t.decode() for t in texts], num_threads=1, add_bos=begin, add_eos=end
            )
            ids = [np.array(x, np.int64) for x in found]
            spans = [loaded.spans(t, x) for t, x in zip(texts, ids, strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())

            def lists(parts: list[np.ndarray], offsets=offsets) -> pa.ListArray:
                flat = np.concatenate(parts) if parts else np.zeros(0)
                return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))

            packed = [x.astype("<u4").tobytes() for x in ids]
            columns = [
                batch.column("doc_id"), lists(ids), lists([s[0] for s in spans]), lists([s[1] for s in spans]),
                pa.array(packed, pa.binary()),
            ]
            if decoded:
                columns.append(pa.array(loaded.processor.decode(found, num_threads=1), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {
        "doc_id": dict(docs.dtypes)["doc_id"], "ids": "array<int>", "begins": "array<int>", "ends": "array<int>",
        "ids_packed": "binary", **({"decoded": "string"} if decoded else {}),
    }
    names = list(kinds)
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """For stored ids: adds the decoded text in place of the ids; a null list gives a null text. A column named
    like the new one is replaced."""
    others = [c for c in encoded.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _model(model)
        for batch in (part for whole in batches for part in slices(whole, ids, SLICE_IDS)):
            lists = batch.column(ids).to_pylist()
            texts = loaded.processor.decode([x or [] for x in lists], num_threads=1) if lists else []
            texts = [None if x is None else t for x, t in zip(lists, texts, strict=True)]
            columns = [*(batch.column(c) for c in others), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*others, text])

    kept = encoded.select(*others, ids)
    fields = [*kept.select(*others).schema.fields, T.StructField(text, T.StringType())]
    return kept.mapInArrow(run, T.StructType(fields))
