"""Exact similarity join of texts by their shingles of characters, without moving sets.

A text's set holds the 64-bit hashes of its distinct runs of ``width`` code
points. Two sets link when intersection / union reaches num / den; then the
larger one's size m bounds what only one of them holds by k = (den - num) * 2m
/ (den + num). Hashes fall into p = k + c parts by their first bits, so at least
c parts of two that link are equal, whatever their tokens' frequencies are. A
part's sum of hashes is its mark; a set has some p marks instead of n tokens.

1. Sizes fall into bands, so that a set's larger partners are in its own band
   or the next. It has marks for both, with the parts of that band.
2. Marks meet in packs. Those that no other set holds cannot be shared, and a
   set with less than c others is like no other.
3. Of a set's marks, the rarest k + 1 must hold one that a partner's hold too.
   Two sets meet at the first of each run of marks that both hold.
4. The texts of what is left are read again and meet in buckets: a pair goes to
   that of the most frequent mark of its sets, so near copies gather there and a
   text is sent once for all its pairs of a bucket. What a mark that many sets
   hold gathers is cut into parts by both texts.
5. A set has a bit for each token's place, which every second token there turns
   back: as many bits as two sets differ in, so many tokens at least only one of
   them holds. Whole sets of what these leave are intersected.

Equal sets form a class, named by 128 bits of its set and its block. Texts come
in lower case with single blanks, as ``functions.text.folded`` gives them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import mapped, trim
from ..functions.tables import forget, settle, written
from .packs import binaries, exchange
from .packs import counted as by_count
from .setjoin import mix, sliced

#: Parts beyond the bound k, as a share of it: they are marks that two that link must share.
SPARE = 8
#: Marks keep so many of their first bits; what else is equal is told apart by whole sets.
_MARK = np.uint64(0xFFFFFFFFFFFF0000)
#: Sets that meet in a part of a bucket from each side, and bytes of sets that a worker keeps between pairs.
CROWD, _HELD = 256, 1 << 25
_CLASS = "unit long, block long, x long, y long, n long"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all rows' runs of ``width`` code points, and each row's first (one more than rows)."""
    texts = texts.fill_null("").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    reach = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[bounds - bounds[0]]
    h = np.zeros(max(len(points) - width + 1, 0), np.uint64)
    for i in range(width):
        h = mix(h + points[i : i + len(h)] + np.uint64(i + 1))
    rows, first = [], [0]
    for a, b in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True):
        own = np.sort(h[a : max(b - width + 1, a)])
        if len(own):
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        rows.append(own)
        first.append(first[-1] + len(own))
    return np.concatenate(rows) if rows else np.zeros(0, np.uint64), np.array(first)


def sums(tokens: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """Sums of the hashes between consecutive bounds under a seed."""
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens ^ np.uint64(seed)), out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def digests(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, in two halves."""
    sizes = np.diff(first).astype(np.uint64)
    return mix(sums(tokens, first, 0x51AC) + sizes), mix(sums(tokens, first, 0xA7D3) + sizes)


def band_bounds(most: int, num: int, den: int) -> np.ndarray:
    """First sizes of all bands up to the second after that of ``most``: a partner of at most a set's size is in its band or the one before."""
    out = [1]
    while out[-1] <= most or out[-2] <= most or out[-3] <= most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array(out)


def marks(tokens: np.ndarray, first: np.ndarray, block: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marks of rows cut into so many parts, and each row's first. ``block`` is a hash that marks of all partners share."""
    row = np.repeat(np.arange(len(parts)), np.diff(first))
    at = np.concatenate([[0], np.cumsum(parts)])
    part = at[row] + ((tokens >> np.uint64(32)) * parts.astype(np.uint64)[row] >> np.uint64(32)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=at[-1]))])
    owner = np.repeat(np.arange(len(parts)), parts)
    place = (np.arange(at[-1]) - at[owner]).astype(np.uint64)
    return mix(sums(tokens, ends, 0x3B91) + mix(place ^ block[owner])) & _MARK, at


def _texts(texts: DataFrame) -> DataFrame:
    """Rows (unit, block, paired, text) of rows (unit, block columns, text): nothing is paired across or without blocks."""
    names = [c for c in texts.columns if c not in ("unit", "text")]
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull()
    return texts.select(F.col("unit").cast("long").alias("unit"), F.xxhash64(F.lit(0), *names).alias("block"), known.alias("paired"), "text")


def _note(s: pa.RecordBatch, first: np.ndarray, tokens: np.ndarray) -> list[pa.Array]:
    x, y = digests(tokens, first)
    return [s.column(0), s.column(1), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.diff(first).astype(np.int64))]


def _heads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block", "x", "y").agg(F.min("unit").alias("head"))


def members(texts: DataFrame, width: int, least: int) -> DataFrame:
    """Rows (unit, head) of texts whose sets have at least ``least`` shingles: the smallest unit of an equal set in the block.

    ``texts`` has (unit: long, text, and the block columns); missing blocks are a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sliced(b, "text"):
                tokens, first = shingle_sets(s.column(3), width)
                yield pa.record_batch(_note(s, first, tokens), ["unit", "block", "x", "y", "n"]).filter(pa.array(np.diff(first) >= least))

    return _members(mapped(_texts(texts), run, _CLASS))


def _members(rows: DataFrame) -> DataFrame:
    return rows.join(_heads(rows), ["block", "x", "y"]).select("unit", "head")


def joined(texts: DataFrame, width: int, least: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, shared, total) of heads that link, a < b, and ``members``.

    Texts are read twice and in the same order when a task runs again: from files.
    """
    answers: list[DataFrame] = []

    def kept(met: DataFrame) -> DataFrame:
        answers.append(written(met, "answers"))
        settle(met.sparkSession)
        return answers[-1]

    # A write frees what the one before it has shuffled.
    found = written(_marked(_texts(texts), width, least, num, den, kept), "marked", release=True)
    forget(answers[-1])
    named = written(found.where("home").select("unit", "block", "x", "y"), "named", release=True)
    sets = written(_sets(found), "sets", release=True)
    forget(found)
    heads = written(_placed(sets), "heads", release=True)
    met = written(_met(_lists(sets), heads), "met", release=True)
    forget(sets)
    forget(heads)
    pairs = _verified(met, texts.select(F.col("unit").cast("long").alias("unit"), "text"), width, num, den)
    forget(met)
    return pairs, _members(named)


def _marked(texts: DataFrame, width: int, least: int, num: int, den: int, between: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each text's class twice, for its own band (home) and the next: how many marks it has and must share, and those that others have, with levels of how many."""

    def kernel(b: pa.RecordBatch, seen: set) -> Iterator[tuple]:
        for s in sliced(b, "text"):
            tokens, first = shingle_sets(s.column(3), width)
            note = pa.record_batch(_note(s, first, tokens), ["unit", "block", "x", "y", "n"])
            sizes = np.diff(first)
            lower = band_bounds(int(sizes.max()), num, den)
            own = np.searchsorted(lower, sizes, "right") - 1
            block = np.asarray(s.column(1)).view(np.uint64)
            fresh = np.zeros(len(sizes), bool)
            names = np.column_stack([block, *(np.asarray(note.column(i)).view(np.uint64) for i in (2, 3))])
            for i, (name, paired) in enumerate(zip(map(bytes, names), s.column(2).to_pylist(), strict=True)):
                if paired and sizes[i] >= least:
                    fresh[i] = name not in seen
                    seen.add(name)
            chosen = np.flatnonzero(fresh)
            held = np.repeat(fresh, sizes)
            first = np.concatenate([[0], np.cumsum(sizes[chosen])])
            kept = pa.array(sizes >= least)
            place = np.cumsum(sizes >= least) - 1
            for home in (True, False):
                band = own + (not home)
                k = 2 * (lower[band + 1] - 1) * (den - num) // (den + num)
                more = np.maximum(k // SPARE, 1)
                values, at = marks(tokens[held], first, mix(block[chosen] ^ mix(band[chosen].astype(np.uint64))), (k + more)[chosen])
                columns = [*note.columns, pa.array(np.full(len(sizes), home)), pa.array(k + more), pa.array(more)]
                yield values, np.repeat(place[chosen], np.diff(at)), int(kept.true_count), [], pa.record_batch(columns, [*note.schema.names, "home", "parts", "need"]).filter(kept)

    def decide(first: np.ndarray, n: int, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        total = np.add.reduceat(count.astype(np.int64), first) if n else np.zeros(0, np.int64)
        return total > 1, [np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)]

    def assemble(notes: pa.Table, units: np.ndarray, values: np.ndarray, levels: np.ndarray) -> pa.Table:
        first = np.searchsorted(units, np.arange(notes.num_rows + 1))
        few = np.diff(first) < notes["need"].to_numpy()
        return notes.append_column("marks", binaries(values, first, few)).append_column("levels", binaries(levels, first, few))

    schema = f"{_CLASS}, home boolean, parts long, need long, marks binary, levels binary"
    return exchange(texts, kernel, by_count, decide, assemble, schema, ["u4"], ["u1"], values_back=True, between=between)


def _sets(found: DataFrame) -> DataFrame:
    """Rows (id, head, x, home, parts, need, marks, levels): each class and band that has enough marks."""
    one = F.struct("home", "parts", "need", "marks", "levels")
    sides = [F.first(F.when(F.col("marks").isNotNull() & side, one), ignorenulls=True) for side in (F.col("home"), ~F.col("home"))]
    each = found.groupBy("block", "x", "y").agg(F.min("unit").alias("head"), *[s.alias(f"side{i}") for i, s in enumerate(sides)])
    sides = F.filter(F.array("side0", "side1"), lambda s: s.isNotNull())
    return each.select("head", "x", F.inline(sides)).withColumn("id", F.monotonically_increasing_id())


def _placed(sets: DataFrame) -> DataFrame:
    """Rows (id, head, x, place): a set's most frequent mark, behind the level of how many have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sliced(b, "marks"):
                values, levels = (np.frombuffer(b"".join(s.column(i).to_pylist()), kind) for i, kind in ((3, np.uint64), (4, np.uint8)))
                ends = np.cumsum([len(v) for v in s.column(4).to_pylist()])
                places = levels.astype(np.uint64) << np.uint64(55) | values >> np.uint64(9)
                most = np.maximum.reduceat(places, np.concatenate([[0], ends[:-1]]))
                yield pa.record_batch([*s.columns[:3], pa.array(most.view(np.int64))], ["id", "head", "x", "place"])

    return mapped(sets.select("id", "head", "x", "marks", "levels"), run, "id long, head long, x long, place long")


def _lists(sets: DataFrame) -> DataFrame:
    """Rows (mark, who, before): the rarest marks of each set that others have too, and the one before it, if any; ``who`` is twice its id, and one more for its own band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sliced(b, "marks"):
                values = [np.frombuffer(v, np.uint64) for v in s.column(3).to_pylist()]
                held = np.array(list(map(len, values)))
                bound, parts = s.column(2).to_numpy(), s.column(1).to_numpy()
                values, row = np.concatenate(values), np.repeat(np.arange(len(held)), held)
                levels = np.concatenate([np.frombuffer(v, np.uint8) for v in s.column(4).to_pylist()])
                order = np.lexsort((mix(values), levels, row))
                # Marks that no other set holds come first.
                at = np.arange(len(values)) - (np.cumsum(held) - held)[row]
                inside = at + (parts - held)[row] <= bound[row]
                values = values[order].view(np.int64)
                before = pa.array(np.roll(values, 1)[inside], mask=(at == 0)[inside])
                yield pa.record_batch([pa.array(values[inside]), s.column(0).take(pa.array(row[inside])), before], ["mark", "who", "before"])

    who = F.col("id") * 2 + F.col("home").cast("long")
    return mapped(sets.select(who.alias("who"), "parts", (F.col("parts") - F.col("need")).alias("bound"), "marks", "levels"), run, "mark long, who long, before long")


def _met(lists: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidate pairs (a, x, b, y, place), by heads and halves of their sets' names; one of them at least is in its own band.

    All lists have one order, so two that share a mark and the one before it have met there.
    """
    u, v = F.col("u.who"), F.col("v.who")
    apart = F.coalesce(F.col("u.before") != F.col("v.before"), F.lit(True))
    both = lists.alias("u").join(lists.alias("v"), F.col("u.mark") == F.col("v.mark")).where((u < v) & ((u % 2 == 1) | (v % 2 == 1)) & apart)
    pairs = both.select(F.shiftright(u, 1).alias("i"), F.shiftright(v, 1).alias("j")).distinct()
    name = lambda i, head, x, at: heads.select(F.col("id").alias(i), F.col("head").alias(head), F.col("x").alias(x), F.col("place").alias(at))
    named = pairs.join(name("i", "p", "px", "pat"), "i").join(name("j", "q", "qx", "qat"), "j").where("p <> q")
    first = F.col("p") < F.col("q")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return named.select(pick("p", "q").alias("a"), pick("px", "qx").alias("x"), pick("q", "p").alias("b"), pick("qx", "px").alias("y"), F.greatest("pat", "qat").alias("place"))


def parities(tokens: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each row, whether an odd number of its hashes begin with each place; places are a power of two, at least half the row's size."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        bits = max(3, (b - a - 1).bit_length() - 1) if b > a else 3
        odd = np.bincount((tokens[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def differing(x: bytes, y: bytes) -> int:
    """At least so many tokens are in only one of two sets, by their parities."""
    if len(x) == len(y):
        return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
    x, y = sorted((np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y)), key=len)
    return int((x != np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)).sum())


def _asked(texts: DataFrame, width: int) -> DataFrame:
    """Rows (unit, x, n, odd, packed): texts, compressed, with half of their sets' names, sizes and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sliced(b, "text"):
                tokens, first = shingle_sets(s.column(1), width)
                x = digests(tokens, first)[0].view(np.int64)
                packed = [zlib.compress((t or "").encode(), 1) for t in s.column(1).to_pylist()]
                columns = [pa.array(x), pa.array(np.diff(first).astype(np.int64)), pa.array(parities(tokens, first), pa.binary()), pa.array(packed, pa.binary())]
                yield pa.record_batch([s.column(0), *columns], ["unit", "x", "n", "odd", "packed"])

    return mapped(texts, run, "unit long, x long, n long, odd binary, packed binary")


def _units(pairs: DataFrame) -> DataFrame:
    """Rows (unit, buckets) of pairs' sides."""
    sides = pairs.select(F.col("a").alias("unit"), "bucket").unionByName(pairs.select(F.col("b").alias("unit"), "bucket"))
    return sides.groupBy("unit").agg(F.collect_set("bucket").alias("buckets"))


def _gathered(pairs: DataFrame, units: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """Pairs (bucket, a, x, b, y) and the texts of their sides (bucket, a: unit, x, and columns)."""
    none = lambda c: F.lit(None).cast(texts.schema[c].dataType if c in columns else "long").alias(c)
    told = texts.join(units, "unit").select(F.explode("buckets").alias("bucket"), F.col("unit").alias("a"), "x", none("b"), none("y"), *columns)
    return told.unionByName(pairs.select("bucket", "a", "x", "b", "y", *map(none, columns)))


def _sides(table: pa.Table) -> tuple[dict[tuple[int, int], int], pa.Table, zip]:
    """Of what a bucket gathered: the row of each text, texts, and pairs by a and b."""
    trim()
    told = table.filter(table["b"].is_null()).combine_chunks()
    pairs = table.filter(table["b"].is_valid()).sort_by([("a", "ascending"), ("b", "ascending")])
    # Rows that share an id and a set are one.
    known = {unit: i for i, unit in enumerate(zip(told["a"].to_pylist(), told["x"].to_pylist(), strict=True))}
    return known, told, zip(*(pairs[c].to_pylist() for c in ("a", "x", "b", "y")), strict=True)


def _close(table: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs (bucket, a, x, b, y) of a bucket that sizes and parities leave."""
    known, told, pairs = _sides(table)
    sizes, odd = told["n"].to_pylist(), told["odd"].to_pylist()
    out = []
    for pair in pairs:
        i, j = known[pair[:2]], known[pair[2:]]
        m, n = sizes[i], sizes[j]
        if den * min(m, n) >= num * max(m, n) and differing(odd[i], odd[j]) <= (m + n) * (den - num) // (den + num):
            out.append(pair)
    bucket = pa.array([table["bucket"][0].as_py()] * len(out), pa.int32())
    return pa.table([bucket, *(pa.array([p[i] for p in out], pa.int64()) for i in range(4))], ["bucket", "a", "x", "b", "y"])


def _linked(table: pa.Table, width: int, num: int, den: int) -> pa.Table:
    """Rows (a, b, shared, total) of a bucket's pairs that link."""
    known, told, pairs = _sides(table)
    texts = told["packed"].to_pylist()
    sets: dict[int, np.ndarray] = {}
    held = 0

    def whole(i: int) -> np.ndarray:
        nonlocal held
        if i not in sets:
            if held > _HELD:
                sets.clear()
                held = 0
            sets[i] = shingle_sets(pa.array([zlib.decompress(texts[i]).decode()]), width)[0]
            held += sets[i].nbytes
        return sets[i]

    out: list[list[int]] = [[], [], [], []]
    for a, x, b, y in pairs:
        u, v = whole(known[a, x]), whole(known[b, y])
        at = np.searchsorted(u, v)
        at[at == len(u)] = 0
        shared = int((u[at] == v).sum())
        total = len(u) + len(v) - shared
        if den * shared >= num * total:
            for c, value in zip(out, (a, b, shared, total), strict=True):
                c.append(value)
    return pa.table([pa.array(c, pa.int64()) for c in out], ["a", "b", "shared", "total"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Rows (a, b, shared, total) of the candidates that link, by the whole sets of their texts."""

    def close(table: pa.Table) -> pa.Table:
        return _close(table, num, den)

    def linked(table: pa.Table) -> pa.Table:
        return _linked(table, width, num, den)

    buckets = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowds = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(2.0), F.shiftright("place", 55) / 8) / CROWD))
    part = lambda unit: F.pmod(F.xxhash64(unit), crowds)
    pairs = pairs.select(F.pmod(F.xxhash64("place", part("a"), part("b")), F.lit(buckets)).cast("int").alias("bucket"), "a", "x", "b", "y")
    units = written(_units(pairs), "units", release=True)
    ids = written(units.select("unit"), "ids", release=True)
    asked = written(_asked(texts.join(ids, "unit", "left_semi"), width), "texts", release=True)
    met = _gathered(pairs, units, asked, "n", "odd").groupBy("bucket")
    near = written(met.applyInArrow(close, "bucket int, a long, x long, b long, y long"), "near", release=True)
    # A table's size is known, so that texts need not move to meet a small one.
    left = written(_units(near), "left", release=True)
    met = _gathered(near, left, asked, "packed").groupBy("bucket")
    found = written(met.applyInArrow(linked, "a long, b long, shared long, total long").distinct(), "pairs", release=True)
    for gone in (units, ids, asked, near, left):
        forget(gone)
    return found
