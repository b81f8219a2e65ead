"""Exact set-similarity joins on sets of 64-bit tokens.

Two sets are alike when intersection / union reaches a threshold num / den, in
integers. Each order of all tokens gives both sets a prefix of n - ceil(t * n)
+ 1 tokens that share one. Orders place rare tokens first and break ties by a
hash of their own; tokens that no other set holds stand before all others.

``counted`` drops those tokens, and sets that have too few others to be like
any; ``lists`` cuts prefixes, with the largest set that a token's place leaves
room for; ``paired`` and ``every_pair`` join lists; ``met`` keeps pairs that share a
prefix token under all orders; ``verified`` intersects whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import mapped
from .packs import binaries, exchange
from .packs import counted as by_count

#: Seeds of the token orders.
ORDERS = (0x1F3D5B79, 0x2E4C6A88, 0x3D5B7997)
#: Rows of sets handled at a time, by bytes of their tokens.
SLICE_BYTES = 1 << 20
COUNTED = "id long, n long, tokens binary, levels binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sliced(b: pa.RecordBatch, column: str = "tokens") -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most SLICE_BYTES, or of one row."""
    if b.num_rows:
        sizes = np.asarray(pc.binary_length(b.column(b.schema.get_field_index(column)))).astype(np.int64)
        reach = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(reach, reach[at] + SLICE_BYTES, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def prefixes(tokens: np.ndarray, levels: np.ndarray, first: np.ndarray, sizes: np.ndarray, seed: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the prefix of their set under one order, by row and place, and those places.

    ``sizes`` counts all tokens of a set; those not in ``tokens`` come first.
    """
    held = np.diff(first)
    row = np.repeat(np.arange(len(held)), held)
    key = levels.astype(np.uint64) << np.uint64(56) | mix(tokens ^ np.uint64(seed)) >> np.uint64(8)
    order = np.lexsort((key, row))
    place = np.arange(len(tokens)) - first[row] + (sizes - held)[row]
    inside = place < (sizes - -(-sizes * num // den) + 1)[row]
    return order[inside], place[inside]


def counted(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (id, n, tokens, levels) from rows (id, n, tokens): shared tokens, and levels of how many sets hold them.

    Sets with less than the share num / den of shared tokens are left out: they are like no other.
    """

    def kernel(b: pa.RecordBatch, _: set) -> Iterator[tuple]:
        for s in sliced(b):
            tokens = [np.frombuffer(x, np.uint64) for x in s.column(2).to_pylist()]
            yield np.concatenate(tokens), np.repeat(np.arange(len(tokens)), list(map(len, tokens))), len(tokens), [], s.select([0, 1])

    def decide(first: np.ndarray, n: int, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        total = np.add.reduceat(count.astype(np.int64), first) if n else np.zeros(0, np.int64)
        return total > 1, [np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)]

    def assemble(notes: pa.Table, units: np.ndarray, tokens: np.ndarray, levels: np.ndarray) -> pa.Table:
        sizes = notes["n"].to_numpy()
        order = np.lexsort((tokens, units))
        first = np.searchsorted(units, np.arange(len(sizes) + 1))
        enough = pa.array((np.diff(first) > 0) & (den * np.diff(first) >= num * sizes))
        out = notes.append_column("tokens", binaries(tokens[order], first)).append_column("levels", binaries(levels[order], first))
        return out.filter(enough)

    return exchange(sets.select("id", "n", "tokens"), kernel, by_count, decide, assemble, COUNTED, ["u4"], ["u1"], values_back=True)


def lists(sets: DataFrame, num: int, den: int, order: int = 0) -> DataFrame:
    """Rows (token, id, n, place, reach, common): one order's prefixes of ``counted`` sets.

    ``reach`` is the largest set that the token's place leaves room for: from
    that place on, the overlap that a link needs must still fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sliced(b):
                ids, sizes = s.column(0).to_numpy(), s.column(1).to_numpy()
                tokens = [np.frombuffer(x, np.uint64) for x in s.column(2).to_pylist()]
                held = np.array(list(map(len, tokens)))
                first = np.concatenate([[0], np.cumsum(held)])
                flat = np.concatenate(tokens)
                levels = np.concatenate([np.frombuffer(x, np.uint8) for x in s.column(3).to_pylist()])
                at, place = prefixes(flat, levels, first, sizes, ORDERS[order], num, den)
                row = np.repeat(np.arange(len(held)), held)[at]
                reach = (num + den) * (sizes[row] - place) // num - sizes[row]
                yield pa.record_batch([pa.array(x) for x in (flat[at].view(np.int64), ids[row], sizes[row], place, reach, (held / sizes)[row])], ["token", "id", "n", "place", "reach", "common"])

    return mapped(sets, run, "token long, id long, n long, place long, reach long, common double")


def paired(x: DataFrame, y: DataFrame, on: list[str], where: Column) -> DataFrame:
    """Distinct pairs (a < b) of members of lists that meet under ``where``; y's columns end in _y."""
    met = x.join(y, on).where(where & (F.col("n_y") <= F.col("reach")) & (F.col("n") <= F.col("reach_y")))
    return met.select(F.least("id", "id_y").alias("a"), F.greatest("id", "id_y").alias("b")).distinct()


def every_pair(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of all ``counted`` sets.

    What two prefixes share, and what can follow the last token that they
    share, must reach the overlap that a link needs.
    """
    members = lists(sets, num, den)
    other = members.select("token", *[F.col(c).alias(f"{c}_y") for c in ("id", "n", "place", "reach")])
    together = members.join(other, "token").where("id < id_y and n_y <= reach and n <= reach_y")
    pairs = together.groupBy(F.col("id").alias("a"), F.col("id_y").alias("b")).agg(
        F.count("*").alias("shared"), F.max("n").alias("n"), F.max("n_y").alias("m"), F.max("place").alias("i"), F.max("place_y").alias("j")
    )
    most = F.col("shared") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    return pairs.where(most * (num + den) >= num * (F.col("n") + F.col("m"))).select("a", "b")


def _heads(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (id, heads, cut): the prefixes of the other orders behind one another, each sorted, and the first one's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sliced(b):
                sizes = s.column(1).to_numpy()
                tokens = [np.frombuffer(x, np.uint64) for x in s.column(2).to_pylist()]
                first = np.concatenate([[0], np.cumsum(list(map(len, tokens)))])
                flat = np.concatenate(tokens)
                levels = np.concatenate([np.frombuffer(x, np.uint8) for x in s.column(3).to_pylist()])
                row = np.repeat(np.arange(len(sizes)), np.diff(first))
                parts, owner = [], []
                for k, seed in enumerate(ORDERS[1:]):
                    at, _ = prefixes(flat, levels, first, sizes, seed, num, den)
                    parts.append(flat[at])
                    owner.append(row[at] * 2 + k)
                every, owner = np.concatenate(parts), np.concatenate(owner)
                order = np.lexsort((every, owner))
                bounds = np.searchsorted(owner[order], np.arange(2 * len(sizes) + 1))
                yield pa.record_batch([s.column(0), binaries(every[order], bounds[::2]), pa.array(np.diff(bounds)[::2])], ["id", "heads", "cut"])

    return mapped(sets, run, "id long, heads binary, cut long")


def met(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (a, b) whose prefixes share a token under every other order too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, i, y, j in zip(*(b.column(c).to_pylist() for c in (1, 2, 4, 5)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(_share(x[:i], y[:j]) and _share(x[i:], y[j:]))
            yield pa.record_batch([b.column(0), b.column(3)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    heads = _heads(sets, num, den)
    side = lambda c: heads.select(F.col("id").alias(c), F.col("heads").alias(f"heads_{c}"), F.col("cut").alias(f"cut_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return mapped(both.select("a", "heads_a", "cut_a", "b", "heads_b", "cut_b"), run, "a long, b long")


def _share(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays share a value."""
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return bool((x[at] == y).any())


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (a, b, shared, total) of the candidates that are alike, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, n, x, c, m, y in zip(*(v.to_pylist() for v in b.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                shared = int((x[at] == y).sum())
                total = n + m - shared
                if den * shared >= num * total:
                    out.append((a, c, shared, total))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared", "total"])

    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return mapped(both.select("a", "n_a", "tokens_a", "b", "n_b", "tokens_b"), run, "a long, b long, shared long, total long")
