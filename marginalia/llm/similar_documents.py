"""N-gram Jaccard join with several global token orders.

A document's set holds its distinct n-word shingles, lower-cased (A-Z); with
fewer words the whole sequence is one. Documents with equal sets form a class,
and classes are joined: two link when intersection / union reaches the
threshold t, in integers. If they do, each order of all tokens gives both sets
a prefix of n - ceil(t * n) + 1 tokens that share one. Every order places rare
tokens first and breaks ties by a hash of its own. A pair must share a prefix
token under every order before it is verified.

1. Tokens of all sets meet in packs. Those that no other set holds cannot be in
   an intersection; a set with less than the share t of other tokens links with
   nothing. What is left meets once more, class by class, for exact counts.
2. The first order's prefixes form lists by token. Each list names a
   representative, the member with the largest share of common tokens, and
   every member pairs with it.
3. A pair is kept where its sizes and the places of the token leave room for
   the overlap; then the other orders' prefixes are intersected, then whole
   sets. Links make components.
4. Members of a list that are in different components by then pair with each
   other under the same bounds, by a join on token and size, and are verified.
   Pairs inside a component can tell nothing new.

So a group of any number of near copies costs rows in proportion to its
members, and no link between unconnected classes is lost. Tokens are 64-bit
hashes of shingles; a class is named by 128 bits of its set.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing; equal sets link at any size; repeated rows and rows
that share an id are each returned with the component of their set; a null id
never names a component unless nothing else could (then it is null); very long
texts count in full; no rows give no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import setjoin
from ..operators.packs import binaries, counted, exchange, repeated
from . import common
from .words import grams, mix, slices, words

#: Ratio of the size bands in which members of a list meet.
BAND = 1.03
_SETS = "key long, n long, class binary, tokens binary"


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and each row's first (one more than rows)."""
    w = words(texts, lower=True)
    h = w.hashes()
    g, at = grams(h, w, n)
    row = w.row[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for i in range(n - 1):
            more = w.counts[few] > i
            whole[more] = mix(whole[more] * np.uint64(31) + h[w.first[few[more]] + i] + np.uint64(i + 1))
        g, row = np.concatenate([g, whole]), np.concatenate([row, few])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[keep], row[keep]
    return g, np.searchsorted(row, np.arange(len(texts) + 1))


def set_digests(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each row's set: sums of two mixed hashes, mixed again."""
    sums = []
    for seed in (0x51, 0xA7):
        total = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(mix(g ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))), out=total[1:])
        sums.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)))
    return np.column_stack(sums)


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (key, n, class, tokens) of all documents; tokens that other documents hold, where they may suffice for a link."""

    def kernel(b: pa.RecordBatch, seen: set) -> Iterator[tuple]:
        for s in slices(b):
            g, first = shingle_sets(s.column(1), n)
            digest, sizes = set_digests(g, first), np.diff(first)
            fresh = np.zeros(len(sizes), bool)
            for i, d in enumerate(map(bytes, digest)):
                fresh[i] = d not in seen
                seen.add(d)
            name = binaries(digest.reshape(-1), np.arange(len(sizes) + 1) * 2)
            note = pa.record_batch([s.column(0), pa.array(sizes), name], ["key", "n", "class"])
            yield g[np.repeat(fresh, sizes)], np.repeat(np.flatnonzero(fresh), sizes[fresh]), len(sizes), [], note

    def assemble(notes: pa.Table, units: np.ndarray, tokens: np.ndarray) -> pa.Table:
        sizes = notes["n"].to_numpy()
        order = np.lexsort((tokens, units))
        first = np.searchsorted(units, np.arange(len(sizes) + 1))
        held = np.diff(first)
        few = (held == 0) | (100 * held < percent * sizes)
        return notes.append_column("tokens", binaries(tokens[order], first, few))

    return exchange(docs, kernel, counted, repeated, assemble, _SETS, ["u4"], [], values_back=True)


def _links(pairs: DataFrame, sets: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Links (a, b) among candidates (a, b): prefixes of the other orders are intersected, then whole sets."""
    return setjoin.verified(setjoin.met(pairs, sets, *ratio), sets, *ratio).select("a", "b")


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (node, component) of the classes that link, by their ids."""
    ratio = (percent, 100)
    lists = common.written(setjoin.lists(sets, *ratio), "lists")
    member = F.struct("id", "n", "reach")
    shared = lists.groupBy("token").agg(F.count("*").alias("length"), F.max_by(member, F.struct("common", "id")).alias("head")).where("length > 1")
    heads = common.written(shared.select("token", *[F.col(f"head.{c}").alias(f"{c}_y") for c in ("id", "n", "reach")]), "heads", release=True)
    first = setjoin.paired(lists, heads, ["token"], F.col("id") != F.col("id_y"))
    first = common.written(_links(first, sets, ratio), "links", release=True)
    known = common.written(common.components(first, "components"), "known")
    # Lists whose members are not all connected yet.
    rows = lists.join(heads.select("token"), "token").join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = common.written(rows.drop("common", "place"), "rows", release=True)
    # Of two members that link, the smaller one's place leaves room for its own size at least.
    band = lambda c: F.floor(F.log(F.col(c).cast("double")) / float(np.log(BAND)))
    early = rows.where("reach >= n").groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    every = rows.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    opened = common.written(every.where("least < most").join(early.select("token"), "token").select("token"), "opened")
    rows = rows.join(opened, "token")
    y = rows.where("reach >= n").withColumn("band", F.explode(F.sequence(band("n"), band("reach"))))
    y = y.select("token", "band", *[F.col(c).alias(f"{c}_y") for c in ("id", "n", "reach", "component")])
    other = (F.col("component") != F.col("component_y")) & ((F.col("n") > F.col("n_y")) | ((F.col("n") == F.col("n_y")) & (F.col("id") < F.col("id_y"))))
    rest = common.written(setjoin.paired(rows.withColumn("band", band("n")), y, ["token", "band"], other), "pairs", release=True)
    links = common.written(_links(rest, sets, ratio).unionByName(first), "links", release=True)
    for gone in (lists, heads, opened, rest, known, first):
        common.forget(gone)
    return common.components(links, "components")


def similar(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_shingles, component_id): the smallest key that links reach from each row."""
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = common.written(_sets(texts, n, percent), "found", release=True)
    sets = found.where("tokens is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = common.written(sets.withColumn("id", F.monotonically_increasing_id()), "sets", release=True)
    shared = common.written(setjoin.counted(sets, percent, 100), "counted", release=True)
    names = linked(shared, percent)
    roots = sets.select(F.col("id").alias("component"), F.col("class").alias("root"))
    roots = names.join(roots, "component").join(sets.select(F.col("id").alias("node"), "class"), "node").select("class", "root")
    rows = found.select("key", "n", "class").join(common.written(roots, "roots"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rows = common.written(rows.select("key", "n", "root"), "rows", release=True)
    least = common.written(rows.where("n > 0").groupBy("root").agg(F.min("key").alias("component_id")), "least")
    for gone in (found, sets, shared):
        common.forget(gone)
    named = rows.where("n > 0").join(least, "root").select("key", "n", "component_id")
    empty = rows.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return named.unionByName(empty).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
