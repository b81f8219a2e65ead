"""Compressed texts on their way through a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from .words import buffers, slices


def compressed(texts: pa.Array) -> pa.Array:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    data, offsets = buffers(texts)
    return pa.array([squeeze(data[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def unzipped(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with their texts in place of ``body``, a few rows at a time."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    at = b.schema.get_field_index("body")
    for i in range(0, b.num_rows, 64):
        part = b.slice(i, 64)
        text = pa.array([expand(x) for x in part.column(at).to_pylist()], pa.binary()).cast(pa.string())
        yield from slices(part.set_column(at, "text", text))
