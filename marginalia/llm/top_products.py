"""Exact top-k inner products by norm buckets.

Vectors are sorted into buckets of like length and cut into blocks of at most
``BLOCK``. A query first meets the block with the longest vectors, which gives
it a score that its k-th best must reach. For any other block the local
threshold is that score over the product of the query's length and the
block's greatest: above 1 the block cannot hold a result (length pruning) and
is never met. In a block that is met, rows too short for the query are left
out, and where the local cosine threshold is high enough, partial products
over the block's strongest coordinates plus a bound on the rest leave out more
(coordinate pruning). What remains is multiplied exactly in integers.

Queries that need candidates of like length form chunks, and chunks pair with
blocks by the buckets that are long enough, so work is chunks times blocks in
matrix products; no pair of rows is ever a row of Spark.

Defined results: vectors that are null or hold null or non-finite components
take no part, as queries or candidates; vectors of different lengths do not
compare; ties go to the smaller id; a repeated id is a candidate once for each
of its rows but never for a query of its own id; each query row has results of
its own, also where ids repeat; fewer than k candidates give
fewer rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a block; a task holds one block of queries and one of candidates.
BLOCK = 2048
#: Vectors are dealt to buckets by length in powers of this ratio.
RATIO = 1.1
#: Buckets by which the needs of a chunk's queries differ at most.
STEP = 2
#: Local cosine threshold from which coordinates are pruned.
COORDINATES_FROM = 0.35
#: Integers below this keep every sum of products exact in a double.
_EXACT = 2.0**53


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, v: array of double with whole values, dim, norm2) of the usable vectors."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    rows = usable.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("id", "v", F.size("v").alias("dim"), norm2.alias("norm2"))


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (dim, bucket, part, n, longest, shortest, ids, data): vectors packed by like length.

    A bucket is cut into parts by a hash, so that one bucket may hold any
    share of all rows.
    """
    longest = F.sqrt("norm2")
    bucket = F.when(F.col("norm2") > 0, F.floor(F.log(longest) / float(np.log(RATIO)))).otherwise(-1).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("dim", "bucket").agg(F.count("*").alias("in_bucket"))
    rows = rows.join(sizes, ["dim", "bucket"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("in_bucket") / (BLOCK * 3 // 4)).cast("long")))

    packed = rows.groupBy("dim", "bucket", "part").agg(
        F.count("*").cast("int").alias("n"), F.sqrt(F.max("norm2")).alias("longest"),
        F.collect_list(F.struct("id", "v")).alias("rows"),
    )
    return packed.withColumn("ids", F.col("rows.id")).withColumn("data", F.flatten("rows.v")).drop("rows")


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-valued rows."""
    bound = max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * max(q.shape[1], 1)
    if bound < _EXACT:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return exact.astype(np.int64)  # raises where a score leaves 64 bits


def _best(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best candidates of each query within one block, given scores they must reach: places of queries, ids, scores."""
    out: tuple[list, list, list] = ([], [], [])
    if not len(c):
        return out
    q_norm, c_norm = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(floor > 0, floor / np.maximum(q_norm * c_norm.max(), 1e-300), 0)
    head = np.argsort(-(c * c).sum(0), kind="stable")[: max(c.shape[1] // 3, 1)]
    tail = np.setdiff1d(np.arange(c.shape[1]), head)
    c_tail = np.sqrt((c[:, tail] ** 2).sum(1))
    by_length = np.argsort(-c_norm, kind="stable")
    lengths = c_norm[by_length]
    for i in range(len(q)):
        reach = len(c)
        if floor[i] > 0:  # only vectors long enough; a hair of slack for rounding
            reach = int(np.searchsorted(-lengths, -(floor[i] / max(q_norm[i], 1e-300)) * (1 - 1e-9), "right"))
        at = by_length[:reach]
        if local[i] >= COORDINATES_FROM and len(at):
            bound = c[np.ix_(at, head)] @ q[i, head] + c_tail[at] * np.sqrt((q[i, tail] ** 2).sum())
            at = at[bound >= floor[i] - 1e-6 * abs(floor[i]) - 1e-6]
        at = at[c_ids[at] != q_ids[i]]
        if not len(at):
            continue
        s = _product(q[i : i + 1], c[at])[0]
        if len(s) > 4 * k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[s >= cut], s[s >= cut]
        order = np.lexsort((c_ids[at], -s))[:k]
        out[0].extend([i] * len(order))
        out[1].extend(c_ids[at[order]].tolist())
        out[2].extend(s[order].tolist())
    return out


_SCORES = "name long, query_id long, vec_id long, score long"


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """Rows (name, query_id, vec_id, score): the best of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i] for j, n in enumerate(b.schema.names)}
                dim = row["dim"].as_py()
                names = np.asarray(row["q_names"].values)
                q_ids, c_ids = np.asarray(row["q_ids"].values), np.asarray(row["ids"].values)
                q = np.asarray(row["q_data"].values).reshape(len(q_ids), dim)
                c = np.asarray(row["data"].values).reshape(len(c_ids), dim)
                floor = np.asarray(row["floors"].values)
                at, ids, scores = _best(q, q_ids, floor, c, c_ids, k)
                at = np.array(at, np.int64)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (names[at], q_ids[at], ids, scores)], ["name", "query_id", "vec_id", "score"])

    return common.mapped(pairs.select("dim", "q_names", "q_ids", "q_data", "floors", "ids", "data"), run, _SCORES)


def top_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best candidates of ``vectors``."""
    packed = common.written(blocks(quantised(vectors, key, vector, scale)).withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = quantised(queries, key, vector, scale).withColumn("name", F.monotonically_increasing_id())
    asked = common.written(asked, "queries")
    # First pass: each query meets the longest block of its dimension.
    heads = packed.groupBy("dim").agg(F.max_by("block", F.struct("longest", "n", "block")).alias("block")).join(packed, ["dim", "block"])
    none = asked.withColumn("floor", F.lit(float("-inf")))

    def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
        """Queries packed into chunks of about BLOCK by a hash, so that one group may hold all."""
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n_rows"))
        slot = F.pmod(F.xxhash64("name"), F.ceil(F.col("n_rows") / (BLOCK * 3 // 4)).cast("long"))
        dealt = rows.join(sizes, by).groupBy(*by, slot.alias("slot")).agg(F.collect_list(F.struct("name", "id", "v", "floor")).alias("rows"))
        return dealt.select(*by, F.col("rows.name").alias("q_names"), F.col("rows.id").alias("q_ids"), F.flatten("rows.v").alias("q_data"), F.col("rows.floor").alias("floors"))

    first = common.written(_scored(grouped(none, ["dim"]).join(heads, "dim"), k), "first")
    reached = first.groupBy("name").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    floors = asked.join(reached, "name", "left").withColumn(
        "floor", F.when(F.col("n") >= k, F.col("floor").cast("double")).otherwise(float("-inf"))
    )
    # Second pass: queries that need vectors of like length form chunks, and a
    # chunk meets the blocks of the buckets that are long enough for it.
    need = F.floor(F.log(F.col("floor") / F.sqrt("norm2")) / float(np.log(RATIO) * STEP)) * STEP - 1
    least = F.when(F.col("floor") > 0, need).otherwise(F.lit(-(1 << 30))).cast("int")
    chunks = grouped(floors.withColumn("least", least), ["dim", "least"]).withColumn("chunk", F.monotonically_increasing_id())
    chunks = common.written(chunks, "chunks")
    rest = packed.join(heads.select("block"), "block", "left_anti").select("dim", "bucket", "block")
    rest = common.written(rest, "rest")
    # A bucket is a row here, and their number follows from the range of lengths.
    levels = rest.select("dim", "bucket").distinct()
    pairs = chunks.select("dim", "least", "chunk").join(levels, "dim").where("bucket >= least").join(rest, ["dim", "bucket"]).select("chunk", "block")
    met = chunks.join(pairs, "chunk").drop("dim", "least").join(packed, "block")
    second = _scored(met, k)
    both = first.unionByName(second)
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "vec_id"))
    both = both.withColumn("rank", rank).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
