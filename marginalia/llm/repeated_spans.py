"""Substring deduplication over a compacted de Bruijn graph.

Each window of k words is an edge from the node of its first k - 1 words to
the node of its last k - 1. The graph holds the windows that occur twice.

1. Hashes of all windows meet in packs; the windows that occur again go back as
   runs of source coordinates. Of documents with the same words throughout only
   the first one takes part: the others lose all words.
2. The texts of these runs move once. Each node is told with the edge before and
   the edge behind it; a node whose occurrences differ in either (or where a
   run begins or ends at some of them only) branches.
3. Runs are cut at branching nodes. What lies between is a nonbranching path:
   every occurrence of one of its edges lies in an occurrence of the path. It
   compacts to one row, named by a 128-bit digest of the words that stand at its
   coordinates in the source, so that two paths are equal where their words are,
   whatever hashes said.
4. Paths join their first owner, the least id, and spans whose owner is another
   document are cut out of the texts.

Edges and nodes are 64-bit hashes. Two that collide make a run too long or a
node branch too often; both only cost time.

Defined results: a null or empty text has no words; rows without an id neither
lose words nor cause a loss; rows that share an id do not count as each
other's source, whatever their texts; repeated rows are each returned; very
long texts count in full; no rows give no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packs import binaries, counted, exchange, repeated
from . import common
from .bodies import compressed, unzipped
from .words import _PRIME, buffers, grams, mix, slices, words

#: Names of whole texts that a task remembers.
SEEN = 1 << 17
_FOUND = "key long, n_words long, whole binary, runs binary"
_PATHS = "path binary, n int, key long, whole binary, start int"
_DONE = "key long, whole binary, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def wholes(texts: pa.Array) -> tuple[list[bytes], list[int]]:
    """Digests of the rows' words joined by single spaces, and their numbers."""
    data, offsets = buffers(texts)
    names, sizes = [], []
    for i, j in zip(offsets[:-1], offsets[1:], strict=True):
        found = data[i:j].tobytes().split()
        names.append(hashlib.sha256(b" ".join(found)).digest())
        sizes.append(len(found))
    return names, sizes


def _found(texts: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows (key, n_words, whole, null) of all documents, and (key, n_words, whole, runs) of those with windows that occur again.

    ``runs`` are pairs of 32-bit numbers: the first word and the number of windows.
    """

    def kernel(b: pa.RecordBatch, seen: set) -> Iterator[tuple]:
        for s in slices(b):
            names, sizes = wholes(s.column(1))
            usable = np.asarray(s.column(0).is_valid())
            fresh = np.zeros(len(names), bool)
            for i, name in enumerate(names):
                fresh[i] = usable[i] and sizes[i] >= k and name not in seen
                if fresh[i]:
                    seen.add(name)
            w = words(s.column(1))
            edge, at = grams(w.hashes(), w, k)
            mine = fresh[w.row[at]]
            note = pa.record_batch([s.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary())], ["key", "n_words", "whole"])
            yield edge[mine] >> np.uint64(64 - bits) << np.uint64(64 - bits), at[mine], len(w.start), [], note

    def assemble(notes: pa.Table, units: np.ndarray) -> pa.Table:
        units = units.astype(np.int64)
        first = np.concatenate([[0], np.cumsum(notes["n_words"].to_numpy())])
        doc = np.searchsorted(first, units, "right") - 1
        begins = np.ones(len(units), bool)
        begins[1:] = (units[1:] != units[:-1] + 1) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(begins)
        pairs = np.column_stack([units[start] - first[doc[start]], np.diff(np.append(start, len(units)))]).astype(np.int32)
        held, bounds = np.unique(doc[start], return_index=True)
        again = notes.take(pa.array(held)).append_column("runs", binaries(pairs.reshape(-1), np.append(bounds, len(start)) * 2))
        # The first of equal texts stands for all of them here.
        least: dict = {}
        for key, whole in zip(notes["key"].to_pylist(), notes["whole"].to_pylist(), strict=True):
            if key is not None:
                least[whole] = min(key, least.get(whole, key))
        again = again.set_column(0, "key", pa.array([least[x] for x in again["whole"].to_pylist()], pa.int64()))
        return pa.concat_tables([notes.append_column("runs", pa.nulls(len(notes), pa.binary())), again])

    return exchange(texts, kernel, counted, repeated, assemble, _FOUND, ["u4"], [])


def _bodies(texts: DataFrame, k: int) -> DataFrame:
    """Rows (key, whole, body): compressed texts of k words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            for s in slices(b):
                names, sizes = wholes(s.column(1))
                keep = []
                for i, row in enumerate(zip(s.column(0).to_pylist(), names, strict=True)):
                    if sizes[i] >= k and row not in seen:
                        keep.append(i)
                        seen.add(row)
                if len(seen) > SEEN:
                    seen.clear()
                s = s.take(pa.array(keep, pa.int32()))
                yield pa.record_batch([s.column(0), pa.array([names[i] for i in keep], pa.binary()), compressed(s.column(1))], ["key", "whole", "body"])

    return common.mapped(texts.where("key is not null"), run, "key long, whole binary, body binary")


def run_nodes(s: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Node hashes of a slice's runs, hashes of the edges beside each, its word, and the number of words."""
    w = words(s.column(2))
    h = w.hashes()
    every = np.zeros((2, len(h) + k), np.uint64)
    for i, n in enumerate((k, k - 1)):
        g, at = grams(h, w, n)
        every[i, at] = g
    edge, node = every
    runs = np.frombuffer(b"".join(s.column(3).to_pylist()), np.int32).reshape(-1, 2).astype(np.int64)
    of = np.repeat(np.arange(s.num_rows), [len(x) // 8 for x in s.column(3).to_pylist()])
    start, n = runs[:, 0] + w.first[of], runs[:, 1] + 1
    reach = np.cumsum(n)
    at = np.repeat(start - (reach - n), n) + np.arange(reach[-1] if len(reach) else 0)
    before, behind = edge[at - 1], edge[at]
    before[reach - n], behind[reach - 1] = 0, 0
    return node[at], mix(before * np.uint64(_PRIME) + mix(behind)), at, len(h)


def _cuts(bodies: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows (key, whole, cuts): the words at which branching nodes stand in a document's runs."""

    def kernel(b: pa.RecordBatch, _: set) -> Iterator[tuple]:
        for s in unzipped(b):
            node, beside, at, n = run_nodes(s, k)
            sizes = np.diff(words(s.column(2)).first)
            note = pa.record_batch([s.column(0), s.column(1), pa.array(sizes)], ["key", "whole", "n_words"])
            yield node >> np.uint64(64 - bits) << np.uint64(64 - bits), at, n, [beside], note

    def differs(first: np.ndarray, n: int, beside: np.ndarray) -> np.ndarray:
        other = beside != np.repeat(beside[first], np.diff(np.append(first, n)))
        return np.add.reduceat(other, first) > 0 if n else np.zeros(0, bool)

    def fold(first: np.ndarray, n: int, beside: np.ndarray) -> list[np.ndarray]:
        return [beside[first], differs(first, n, beside).astype(np.uint8)]

    def decide(first: np.ndarray, n: int, beside: np.ndarray, branches: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return differs(first, n, beside) | (np.add.reduceat(branches.astype(int), first) > 0 if n else False), []

    def assemble(notes: pa.Table, units: np.ndarray) -> pa.Table:
        first = np.concatenate([[0], np.cumsum(notes["n_words"].to_numpy())])
        bounds = np.searchsorted(units, first)
        within = (units - np.repeat(first[:-1], np.diff(bounds))).astype(np.int32)
        out = notes.select(["key", "whole"]).append_column("cuts", binaries(within, bounds))
        return out.filter(pa.array(np.diff(bounds) > 0))

    return exchange(bodies.select("key", "whole", "body", "runs"), kernel, fold, decide, assemble, "key long, whole binary, cuts binary", ["u8", "u1"], [])


def _paths(bodies: DataFrame, k: int) -> DataFrame:
    """Runs cut at branching nodes: rows (path, n windows, key, whole, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in unzipped(b):
                out = []
                data, offsets = buffers(s.column(2))
                for i, (key, whole, runs, cuts) in enumerate(zip(*(s.column(j).to_pylist() for j in (0, 1, 3, 4)), strict=True)):
                    found = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    cut = np.unique(np.frombuffer(cuts or b"", np.int32)).tolist()
                    at = 0
                    for start, n in np.frombuffer(runs, np.int32).reshape(-1, 2).tolist():
                        while at < len(cut) and cut[at] <= start:
                            at += 1
                        while start is not None:
                            inside = at < len(cut) and cut[at] < start + n
                            end = cut[at] if inside else start + n
                            name = hashlib.blake2b(b" ".join(found[start : end + k - 1]), digest_size=16).digest()
                            out.append((name, end - start, key, whole, start))
                            start, n, at = (end, start + n - end, at + 1) if inside else (None, 0, at)
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "n", "key", "whole", "start"])

    return common.mapped(bodies.select("key", "whole", "body", "runs", "cuts"), run, _PATHS)


def _cut(bodies: DataFrame) -> DataFrame:
    """Cuts spans of words (``spans``: array of structs start, end) out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in unzipped(b):
                out = []
                data, offsets = buffers(s.column(2))
                for i, spans in enumerate(s.column(3).to_pylist()):
                    found = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    mark = np.zeros(len(found) + 1, np.int64)
                    for x in spans:
                        mark[x["start"]] += 1
                        mark[x["end"]] -= 1
                    gone = np.cumsum(mark)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                    kept = b" ".join([x for x, g in zip(found, gone.tolist(), strict=True) if not g])
                    out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in edge.tolist()]))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch([s.column(0), s.column(1), *columns], ["key", "whole", "n_removed", "kept_sha256", "spans"])

    return common.mapped(bodies.select("key", "whole", "body", "spans"), run, _DONE)


def deduplicate(docs: DataFrame, k: int = 13, text: str = "text", key: str = "doc_id", bits: int = 64) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256, spans): spans of words that a smaller id's document holds.

    ``bits`` of the hashes of edges and nodes are used: fewer make more of them collide.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    name = ["key", "whole"]
    found = common.written(_found(texts, k, bits), "found", release=True)
    rows = found.where("runs is null").drop("runs")
    first = common.written(rows.where(F.col("n_words") >= k).groupBy("whole").agg(F.min("key").alias("least")), "first")
    held = found.where("runs is not null").join(first, "whole").where("key = least").groupBy(*name).agg(F.first("runs").alias("runs"))
    held = common.written(held, "held")
    bodies = _bodies(texts, k).join(held, name).groupBy(*name).agg(F.first("body").alias("body"), F.first("runs").alias("runs"))
    bodies = common.written(bodies, "bodies", release=True)
    cuts = common.written(_cuts(bodies, k, bits), "cuts", release=True)
    paths = common.written(_paths(bodies.join(cuts, name, "left"), k), "paths", release=True)
    owners = paths.groupBy("path").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    owners = common.written(owners.drop("most"), "owners")
    spans = paths.join(owners, "path").where("key > least").groupBy(*name).agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (k - 1)).alias("end"))).alias("spans"))
    spans = common.written(spans, "spans", release=True)
    cut = common.written(_cut(bodies.drop("runs").join(spans, name)), "cut", release=True)
    for gone in (held, cuts, paths, owners, spans, bodies):
        common.forget(gone)
    rows = rows.join(first, "whole", "left").withColumn("copy", F.coalesce(F.col("key") > F.col("least"), F.lit(False)))
    out = rows.join(cut, name, "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("key").alias(key), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("whole")))).alias("kept_sha256"),
        F.when(F.col("copy"), every).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
