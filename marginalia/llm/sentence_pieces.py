"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces hold the white-space mark only at their start, so no merge
crosses from a letter to a mark: a text falls into chunks of marks followed by
other characters, and its ids are the chunks' ids in order. Each distinct chunk
is segmented once in a worker, and ids are joined back by position. A model
for which this does not hold, or that rewrites text, gets whole texts instead.

The table of chunks lives in the worker and is bounded by its characters. A
table of the corpus would have to be joined to every word: on 0.1 GB, 26 million
words of which 1.76 million are distinct, that is 8 bytes of hash and 4 of
position for each word on the way and as many for its ids on the way back, three
times the input. Tens of MB of text hold each of their chunks 6.6 times, the corpus 15.

Defined results: a null or empty text has no ids and decodes to the empty
string; every row is returned, repeated ones too; no rows give no rows; very
long texts are encoded whole; all other columns are kept, and ``ids`` or ``decoded`` replace columns so named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import slices

#: Bytes of text segmented at a time, and characters a worker's table may hold
#: between them; beyond it the table starts anew. Each of its chunks costs about
#: 200 bytes more.
BATCH_BYTES, TABLE_CHARS = 1 << 21, 1 << 20
MARK = "▁"
_CHUNK = re.compile(r" *[^ ]+| +")


class Pieces:
    """A model and its table of chunks, kept in a worker between tasks."""

    kept: dict[str, "Pieces"] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.separable = self._separable()
        self.reset()

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.starts = np.zeros(1, np.int64)  # chunk -> its first id in flat; one more entry than chunks
        self.flat = np.zeros(0, np.int32)

    def add(self, chunks: list[str]) -> None:
        """Segments chunks and appends them to the table, whose arrays double when full."""
        n = len(self.place)
        self.chars += sum(map(len, chunks))
        self.place.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        got = self.model.encode(chunks, num_threads=1)
        # A lone mark is what encode("") leaves out.
        got = [g if c else [self.model.piece_to_id(MARK)] for c, g in zip(chunks, got, strict=True)]
        used, sizes = int(self.starts[n]), np.fromiter(map(len, got), np.int64, len(got))
        need = used + int(sizes.sum())
        if len(self.starts) < n + len(got) + 1:
            self.starts = np.concatenate([self.starts, np.zeros(n + len(got) + 1, np.int64)])
        if len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.zeros(need, np.int32)])
        self.starts[n + 1 : n + len(got) + 1] = used + np.cumsum(sizes)
        self.flat[used:need] = np.fromiter((i for g in got for i in g), np.int32, need - used)

    def _separable(self) -> bool:
        """Whether marks only start pieces and the normaliser leaves text alone."""
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not m.is_control(i) and not m.is_unknown(i)]
        probe = "  Åﬁ á  \t\nx y  "
        return (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and not any(m.is_unused(i) for i in range(m.get_piece_size()))
            and m.decode(m.encode(probe)) == probe
        )

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (none null), as a list array."""
        if not self.separable:
            return pa.array(self.model.encode(texts.to_pylist(), num_threads=1), pa.list_(pa.int32()))
        odd = pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}")
        plain, rest = texts.filter(pc.invert(odd)), texts.filter(odd)
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        chunks, ends = [], [0]
        for t in rest.to_pylist():
            if t:
                # The model puts one mark before a text; each chunk's first mark goes without saying.
                chunks += [c[1:] for c in _CHUNK.findall(" " + t.replace(MARK, " "))]
            ends.append(len(chunks))
        known = coded.dictionary.to_pylist()
        place = self.place
        new = list({c for c in [*known, *chunks] if c not in place})
        if self.chars > TABLE_CHARS:
            self.reset()
            place = self.place
            new = list({*known, *chunks})
        self.add(new)
        number = np.fromiter(map(place.__getitem__, known), np.int64, len(known))
        at = np.concatenate([number[np.asarray(coded.indices)], np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))])
        first = np.asarray(split.offsets).astype(np.int64)
        bounds = np.concatenate([first, first[-1] + np.array(ends[1:], np.int64)])
        sizes = self.starts[at + 1] - self.starts[at]
        reach = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(self.starts[at] - reach[:-1], sizes) + np.arange(reach[-1])]
        found = pa.ListArray.from_arrays(pa.array(reach[bounds].astype(np.int32)), pa.array(flat))
        order = np.empty(len(texts), np.int64)
        mask = np.asarray(odd)
        order[np.flatnonzero(~mask)] = np.arange(len(plain))
        order[np.flatnonzero(mask)] = np.arange(len(plain), len(texts))
        return found.take(pa.array(order)) if mask.any() else found

    def decode(self, ids: pa.Array) -> list[str]:
        flat, sizes = ids.flatten().to_pylist() if ids.flatten().null_count else np.asarray(ids.flatten()).tolist(), pc.list_value_length(ids).fill_null(0)
        ends = np.cumsum(np.asarray(sizes)).tolist()
        return self.model.decode([flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]) if ends else []


def _mapped(docs: DataFrame, path: str, source: str, target: str, kind: T.DataType, convert) -> DataFrame:
    """``docs`` with ``target`` computed from ``source``, all other columns kept."""
    base = docs.drop(target) if target != source else docs
    schema = T.StructType([*[f for f in base.schema if f.name != target], T.StructField(target, kind)])
    names = [f.name for f in schema[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for b in batches:
            column = b.schema.get_field_index(source)
            cut = slices(b, source, BATCH_BYTES) if pa.types.is_string(b.schema.field(column).type) or pa.types.is_large_string(b.schema.field(column).type) else (b.slice(i, 256) for i in range(0, b.num_rows, 256))
            for s in cut:
                yield pa.record_batch([*[s.column(s.schema.get_field_index(n)) for n in names], convert(pieces, s.column(column))], [*names, target])

    return common.mapped(base, run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array of int): the ids of each text, without begin or end."""

    def convert(pieces: Pieces, column: pa.Array) -> pa.Array:
        return pieces.encode(column.fill_null(""))

    return _mapped(docs, path, text, ids, T.ArrayType(T.IntegerType()), convert)


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded`` (string): the text of each list of ids; null ids decode as none."""

    def convert(pieces: Pieces, column: pa.Array) -> pa.Array:
        return pa.array(pieces.decode(column), pa.string())

    return _mapped(docs, path, ids, decoded, T.StringType(), convert)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass over the text."""
    return decode(encode(docs, path, text), path)


def ids_digest(ids: str = "ids") -> F.Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)

