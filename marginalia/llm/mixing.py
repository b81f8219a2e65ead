"""Mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and
share 150 % of all words; a target stops at twice its source's words and the
excess is shared again by weight. A document's words are then taken
floor(rate) times, and once more with a probability of the rate's remainder.

Which documents get the extra copy is drawn by the cube method: probabilities
move along null-space directions of the balancing constraints (number of
documents and of words), so both totals stay as they are, until fewer units
than constraints + 1 are open. It runs in blocks of at most ``BLOCK`` documents
of one source, dealt by a hash; what stays open of many blocks meets in new
blocks, until each source has one. The last few open units of a source are the
landing problem: they are taken in part so that the source's total is met.

All choices follow from hashes of id and size, so reruns agree. Defined
results: null and empty texts have size 0 and are taken 0 times; a null source
is a source of its own; repeated rows are each returned, alike up to which of
them is taken; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Units of a block, which one task holds at a time.
BLOCK = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, n_docs, source_size, target) from rows (source, size).

    One row per source meets in one task: the order of sources and the sharing
    of the excess need all of them, and documents have been summed before.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1))
    # Sharing the excess again fills sources in the order of cap over weight:
    # the first k are full when the level of the rest exceeds their ratio.
    ratio = F.col("source_size") * MOST / F.col("weight")
    fill = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after)).withColumn("ratio", ratio)
    open_level = F.when(F.col("level") < F.col("ratio"), F.struct(F.row_number().over(fill).alias("k"), "level"))
    per = per.withColumn("first", open_level).withColumn("level", F.min("first").over(every)["level"])
    cap = F.col("source_size") * MOST
    return per.select("source", "n_docs", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def flight(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Moves probabilities ``p`` to 0 or 1 keeping sum(p) and sum(p * x), as far as three are open.

    ``u`` holds the random numbers that pick between the two ways of a step.
    Units are taken in order; each step settles at least one.
    """
    p = p.astype(float).copy()
    scale = max(float(x.max(initial=0)), 1.0)
    x = x / scale
    held: list[int] = []
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # The direction in which neither total changes: the cross product of (1, 1, 1) and x.
        d = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(d):
            d = (1.0, -1.0, 0.0)
        up = min(((1 - p[k] if e > 0 else p[k]) / abs(e) for k, e in zip(held, d, strict=True) if e), default=0.0)
        down = min(((p[k] if e > 0 else 1 - p[k]) / abs(e) for k, e in zip(held, d, strict=True) if e), default=0.0)
        step = up if u[i] * (up + down) < down else -down
        for k, e in zip(held, d, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * e))
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        held = [k for k in held if 0 < p[k] < 1]
    return p


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["draw", "key", "size"], kind="stable", na_position="last")
    u = (pdf["draw"].to_numpy().astype(np.uint64) >> np.uint64(11)) / float(1 << 53)
    pdf["p"] = flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), np.modf(u * 7919)[0])
    return pdf


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last block of a source: what stays open is taken in part to meet the total."""
    want = float((pdf["p"] * pdf["size"]).sum())
    pdf = _block(pdf)
    p, size = pdf["p"].to_numpy().copy(), pdf["size"].to_numpy(float)
    shut = (p == 0) | (p == 1)
    rest = want - float((p[shut] * size[shut]).sum())
    for i in np.flatnonzero(~shut)[np.argsort(size[~shut], kind="stable")]:
        part = min(max(round(rest), 0), size[i])
        rest -= part
        p[i] = part / size[i] if size[i] else 0.0
    pdf["p"] = p
    return pdf


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Rows (key, source, size, source_size, target, copies, extra, taken) of ``docs``."""
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long").alias("size")
    )
    sized = common.written(sized, "sizes")
    goal = common.written(targets(sized), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # One row per source, met through a shuffle if it outgrows the session's broadcast limit.
    units = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    units = units.withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("long"))
    units = units.withColumn("p", F.col("rate") - F.col("copies")).withColumn("draw", F.xxhash64("key", "size"))
    units = units.withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK).cast("long"))
    kept = ["key", "source", "size", "source_size", "target", "copies", "p", "draw", "blocks"]
    open_units, done = units.select(kept), None
    while True:
        last = open_units.agg(F.max("blocks")).first()[0]
        if last is None:
            break
        grouped = open_units.withColumn("block", F.pmod(F.xxhash64("draw", "blocks"), F.col("blocks")))
        if last <= 1:
            landed = grouped.groupBy("source", "block").applyInPandas(_land, grouped.schema).drop("block")
            done = landed if done is None else done.unionByName(landed)
            break
        flown = common.written(grouped.groupBy("source", "block").applyInPandas(_block, grouped.schema).drop("block"), "flight")
        # A source of one block is not finished here: its open units wait for the landing.
        settled = flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        open_units = flown.where("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK).cast("long"))
    if done is None:
        done = open_units
    extra = F.round(F.col("p") * F.col("size")).cast("long")
    return done.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies",
        extra.alias("extra"), (F.col("copies") * F.col("size") + extra).alias("taken"),
    )


