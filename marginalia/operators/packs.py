"""Packs: 64-bit values of many rows to their equals and back, in two shuffles.

A task gathers the values of its rows into packs of about ``PACK`` values, sorts
them and folds equal ones, so that a pack sends each value once, however often
it holds it. Each pack is cut into buckets by the values' first bits, and equal
values of all packs meet in a bucket's group, as sorted arrays and not as rows.
What the group decides on goes back to the packs it came from, where the rows'
own columns (notes) and the places of folded values wait. The hottest value of
all costs an entry a pack; buckets and packs are bounded, whatever the values.

Packs are numbered by task, so the rows of ``rows`` must come in the same order
when a task runs again: read them from files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..functions.arrow import mapped, trim

#: Values, rows and units of a pack.
PACK, PACK_ROWS, PACK_UNITS = 1 << 20, 1 << 17, 1 << 30
#: Marks the number of a value that a pack holds more than once.
_FOLDED = np.uint32(1 << 31)
_MOVED = "bucket long, pack long, n int, data binary, notes binary"


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array by significance, so that what is alike compresses."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, kinds: list, n: int) -> list[np.ndarray]:
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def binaries(parts: np.ndarray, bounds: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Binary values: the bytes of ``parts`` between consecutive bounds."""
    offsets = (np.asarray(bounds) * parts.dtype.itemsize).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])
    return out if missing is None else pc.if_else(pa.array(~missing), out, pa.scalar(None, pa.binary()))


def starts(values: np.ndarray) -> np.ndarray:
    """The first of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def counted(first: np.ndarray, n: int) -> list[np.ndarray]:
    """A fold that counts the values of each group."""
    return [np.diff(np.append(first, n)).astype(np.uint32)]


def repeated(first: np.ndarray, n: int, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Decides for values that occur more than once."""
    return np.add.reduceat(count, first) > 1 if n else np.zeros(0, bool), []


def exchange(
    rows: DataFrame,
    kernel: Callable[[pa.RecordBatch, set], Iterator[tuple]],
    fold: Callable[..., list[np.ndarray]],
    decide: Callable[..., tuple[np.ndarray, list[np.ndarray]]],
    assemble: Callable[..., pa.Table],
    schema: str,
    state: list,
    back: list,
    values_back: bool = False,
    between: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows of ``schema`` from ``assemble``.

    ``kernel(batch, seen)`` yields (values, units, number of units, extra
    columns, notes): units number what a value belongs to, from 0 in each yield,
    and notes is a record batch; ``seen`` is a set of the current pack.
    ``fold(first, n, *extra)`` gets a pack's columns by value, n rows of which
    ``first`` begin a group, and gives columns of types ``state`` for the groups.
    ``decide(first, n, *state)`` gets what a bucket received, also by value, and
    gives a mask of the groups that go back and columns of types ``back``.
    ``assemble(notes, units, *columns)`` gets a pack's notes and what came back
    to its units; the values are the first column if ``values_back``. ``between``
    may write what goes back, so that the first shuffle can go before the second comes.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, int(np.ceil(np.log2(2 * partitions))))
    shift = np.uint64(64 - bits)
    names = ["bucket", "pack", "n", "data", "notes"]
    returned = ["u4", *(["u8"] if values_back else []), *back]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        notes: list[pa.RecordBatch] = []
        seen: set = set()
        units = size = lines = 0

        def packed() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            order = np.argsort(columns[0])
            values, unit, *more = (c[order] for c in columns)
            del columns, order
            first = starts(values)
            sizes = np.diff(np.append(first, len(values)))
            many = sizes > 1
            place = np.where(many, (np.cumsum(many) - 1).astype(np.uint32) | _FOLDED, unit[first]) if len(first) else unit
            folded = [sizes[many].astype(np.uint32), unit[np.repeat(many, sizes)]]
            columns = [values[first], place, *fold(first, len(values), *more)]
            bounds = np.searchsorted(columns[0] >> shift, np.arange((1 << bits) + 1).astype(np.uint64))
            full = np.flatnonzero(np.diff(bounds))
            for at in range(0, len(full), 1024):
                part = full[at : at + 1024]
                data = [b"".join(planes(c[bounds[i] : bounds[i + 1]]) for c in columns) for i in part.tolist()]
                counts = np.diff(bounds)[part].astype(np.int32)
                yield pa.record_batch([pa.array(part), pa.array(np.full(len(part), number)), pa.array(counts), pa.array(data, pa.binary()), pa.nulls(len(part), pa.binary())], names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, notes[0].schema) as out:
                for b in notes:
                    out.write_batch(b)
            kept = b"".join(x.tobytes() for x in folded)
            yield pa.record_batch([pa.array([-1 - number]), pa.array([number]), pa.array([len(folded[0])], pa.int32()), pa.array([kept], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names)

        for b in batches:
            for values, unit, n, more, note in kernel(b, seen):
                held.append((values, (unit + units).astype(np.uint32), *more))
                notes.append(note)
                units, size, lines = units + n, size + len(values), lines + note.num_rows
                if size >= PACK or lines >= PACK_ROWS or units >= PACK_UNITS:
                    yield from packed()
                    notes, seen, units, size, lines = [], set(), 0, 0, 0
                    number += 1
        if notes:
            yield from packed()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        n = table["n"].to_numpy()
        parts = [unplanes(x, ["u8", "u4", *state], k) for x, k in zip(table["data"].to_pylist(), n.tolist(), strict=True)]
        values, place, *states = [np.concatenate(c) for c in zip(*parts, strict=True)]
        del parts
        order = np.argsort(values, kind="stable")
        first = starts(values[order])
        keep, columns = decide(first, len(values), *(c[order] for c in states))
        group = np.empty(len(values), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
        chosen = np.flatnonzero(keep[group])
        columns = [place[chosen], *([values[chosen]] if values_back else []), *(c[group[chosen]] for c in columns)]
        bounds = np.searchsorted(chosen, np.concatenate([[0], np.cumsum(n)]))
        full = np.flatnonzero(np.diff(bounds))
        data = [b"".join(planes(c[bounds[i] : bounds[i + 1]]) for c in columns) for i in full.tolist()]
        counts = np.diff(bounds)[full].astype(np.int32)
        return pa.table([pa.array(np.full(len(full), key[0].as_py())), table["pack"].combine_chunks().take(pa.array(full)), pa.array(counts), pa.array(data, pa.binary()), pa.nulls(len(full), pa.binary())], names)

    def home(table: pa.Table) -> pa.Table:
        trim()
        n, data, notes = table["n"].to_pylist(), table["data"].to_pylist(), table["notes"].to_pylist()
        own = next(i for i, x in enumerate(notes) if x is not None)
        sizes = np.frombuffer(data[own], np.uint32, n[own]).astype(np.int64)
        folded = np.frombuffer(data[own], np.uint32, offset=4 * n[own])
        parts = [unplanes(x, returned, k) for i, (x, k) in enumerate(zip(data, n, strict=True)) if i != own]
        place, *columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in returned]
        many = place >= _FOLDED
        which = (place[many] & ~_FOLDED).astype(np.int64)
        reach = np.cumsum(sizes[which])
        inside = np.repeat(np.cumsum(sizes)[which] - reach, sizes[which]) + np.arange(reach[-1] if len(reach) else 0)
        units = np.concatenate([place[~many], folded[inside]])
        columns = [np.concatenate([c[~many], np.repeat(c[many], sizes[which])]) for c in columns]
        order = np.argsort(units, kind="stable")
        return assemble(pa.ipc.open_stream(notes[own]).read_all().combine_chunks(), units[order], *(c[order] for c in columns))

    met = mapped(rows, pack, _MOVED).groupBy("bucket").applyInArrow(meet, _MOVED)
    met = between(met) if between else met
    return met.groupBy("pack").applyInArrow(home, schema)
