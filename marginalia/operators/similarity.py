"""Similarity of units within blocks, ownership by rank, containment."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import mapped
from . import setjoin


def classes(units: DataFrame, block: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Folds units of equal token sets: heads (head, tokens, n) and members (unit, head).

    ``units`` has (unit: orderable, tokens: array, and the block columns).
    """
    block = block or []
    units = units.withColumn("tokens", F.sort_array(F.array_distinct("tokens"))).where(F.size("tokens") > 0)
    # Two hashes name a set.
    units = units.withColumn("sets", F.struct(F.xxhash64("tokens").alias("x"), F.xxhash64(F.lit(1), "tokens").alias("y")))
    heads = units.groupBy(*block, "sets").agg(F.min("unit").alias("head"), F.first("tokens").alias("tokens"))
    members = units.select(*block, "unit", "sets").join(heads.select(*block, "sets", "head"), [*block, "sets"])
    return heads.select(*block, "head", "tokens", F.size("tokens").alias("n")), members.select(*block, "unit", "head")


def similar_pairs(heads: DataFrame, threshold: float, block: list[str] | None = None) -> DataFrame:
    """Pairs (a, b, shared, total) of heads with shared / total >= threshold > 0, a < b, within a block.

    ``heads`` has (head: long, tokens: array of distinct tokens, and the block
    columns). Tokens are hashed to 64 bits together with their block.
    """
    ratio = Fraction(str(threshold)).limit_denominator(10**6)
    num, den = ratio.numerator, ratio.denominator
    # Read by both phases below; what an executor loses is computed again.
    sets = hashed(heads, block or []).persist(StorageLevel.MEMORY_AND_DISK)
    kept = setjoin.counted(sets, num, den).persist(StorageLevel.MEMORY_AND_DISK)
    return setjoin.verified(setjoin.every_pair(kept, num, den), kept, num, den)


def hashed(heads: DataFrame, block: list[str]) -> DataFrame:
    """Rows (id, n, tokens: binary) of sets."""
    tokens = F.col("tokens") if heads.schema["tokens"].dataType.simpleString() == "array<bigint>" else F.transform("tokens", lambda t: F.xxhash64(t))
    chosen = heads.select(F.col("head").cast("long").alias("id"), F.xxhash64(F.lit(0), *block).alias("block"), tokens.alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = b.column(2)
            first = np.asarray(sets.offsets).astype(np.int64)
            flat = np.asarray(sets.values).view(np.uint64)[first[0] : first[-1]]
            first = first - first[0]
            block = setjoin.mix(np.asarray(b.column(1)).view(np.uint64))
            flat = setjoin.mix(flat ^ np.repeat(block, np.diff(first)))
            yield pa.record_batch([b.column(0), pa.array(np.diff(first)), setjoin.binaries(flat, first)], ["id", "n", "tokens"])

    return mapped(chosen, run, "id long, n long, tokens binary")


def owners(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows (unit, higher, tied): the smallest partner of greater and of equal rank.

    ``ranks`` has (unit, rank). A unit without a higher partner but with a tied
    one has no clear owner.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mine = ranks.select(F.col("unit").alias("a"), F.col("rank").alias("own"))
    theirs = ranks.select(F.col("unit").alias("b"), F.col("rank").alias("their"))
    met = both.join(mine, "a").join(theirs, "b")
    return met.groupBy(F.col("a").alias("unit")).agg(
        F.min(F.when(F.col("their") > F.col("own"), F.col("b"))).alias("higher"),
        F.min(F.when(F.col("their") == F.col("own"), F.col("b"))).alias("tied"),
    )


def class_owners(pairs: DataFrame, members: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows (unit, higher, tied) like ``owners``, for every member of the classes that ``pairs`` links.

    A member's partners are the others of its class and all members of the
    classes that its own is paired with. A class meets others as its smallest
    id of each rank, so no pair of members is ever a row. Members without a
    partner have neither owner.
    """
    ranked = members.select("head", "unit").distinct().join(ranks, "unit")
    first = ranked.groupBy("head", "rank").agg(F.min("unit").alias("first"))
    second = ranked.join(first, ["head", "rank"]).where(F.col("unit") > F.col("first")).groupBy("head", "rank").agg(F.min("unit").alias("second"))
    own = first.join(second, ["head", "rank"], "left")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.unionByName(first.select(F.col("head").alias("a"), F.col("head").alias("b")).distinct())
    met = both.join(first.withColumnRenamed("head", "b"), "b").groupBy(F.col("a").alias("head"), "rank")
    met = met.agg(F.min("first").alias("least"), F.min(F.when(F.col("a") != F.col("b"), F.col("first"))).alias("outer"))
    above = Window.partitionBy("head").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("higher", F.min("least").over(above))
    inner = F.when(F.col("unit") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    rows = ranked.join(own, ["head", "rank"]).join(met, ["head", "rank"])
    return rows.select("unit", "higher", F.least("outer", inner).alias("tied"))


def containment(small: DataFrame, large: DataFrame, least: float) -> DataFrame:
    """Rows (item, unit, shared, size) where a unit holds a share of an item's tokens.

    Both have (item or unit, tokens). Of an item's tokens only the size - ceil(least
    * size) + 1 that the fewest units hold need meet; what they meet is intersected whole.
    """
    ratio = Fraction(str(least)).limit_denominator(10**6)
    s = small.select("item", F.array_distinct("tokens").alias("words"))
    # Read for the frequencies, for the rare tokens and for whole sets; what an executor loses is computed again.
    t = large.select("unit", F.array_distinct("tokens").alias("told")).persist(StorageLevel.MEMORY_AND_DISK)
    asked = s.select("item", F.explode("words").alias("token"))
    frequency = t.select(F.explode("told").alias("token")).join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")))
    ranked = asked.join(frequency, "token", "left").groupBy("item").agg(order.alias("order"))
    n = F.size("order")
    reach = n - F.ceil(n * F.lit(ratio.numerator) / F.lit(ratio.denominator) - F.lit(1e-9)) + 1
    rare = ranked.select("item", F.explode(F.slice("order", F.lit(1), reach.cast("int"))).alias("o")).select("item", F.col("o.token").alias("token"))
    met = t.select("unit", F.explode("told").alias("token")).join(rare, "token").select("item", "unit").distinct()
    both = met.join(s, "item").join(t, "unit").select("item", "unit", F.size(F.array_intersect("words", "told")).cast("long").alias("shared"), F.size("words").cast("long").alias("size"))
    return both.where(F.col("shared") * ratio.denominator >= F.col("size") * ratio.numerator)
