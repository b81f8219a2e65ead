"""Quality rules: counting rules and divergence from a language's profile.

Each text gets counts (words, their characters, symbols, repeated lines, words
in repeated windows) and two histograms: classes of characters, and common
words of its language. A language's reference is the sum over all its texts
that pass the counting rules, each text weighing alike. A text fails when the
Jensen-Shannon distance (base 2, 0 to 1) of a histogram from the reference
exceeds the threshold and the text is long enough for the histogram to say
anything (the guards).

Languages without a word list below share one reference and are judged by
characters alone. The table of references has one row per listed language and
one for all others, whatever the input.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows and rows that share an id are each returned; no rows give no
rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import by_row, grams, lines, slices, span_hashes, words

#: The commonest function words of each language.
COMMON = {
    "de": "der die das und in zu den mit von auf ist im nicht ein eine sich des dem für als auch es an".split(),
    "en": "the of and to in a is that for it was on with as be at by this are from or an have not".split(),
    "es": "el la de que y en un una los se del las por con para es al lo no su más como".split(),
    "fr": "le la de et les des en un une du que est pour dans qui par au sur pas ne se plus".split(),
}
#: Characters: a-z, A-Z, 0-9, blanks, line ends, . and comma, other ASCII
#: punctuation, symbols, control, first bytes of longer characters.
CLASSES = 10
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    out = np.full(256, 6, np.uint8)
    out[0:32] = out[127] = 8
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[32, 9]], out[[10, 13]], out[[46, 44]] = 3, 4, 5
    out[list(SYMBOLS)] = 7
    out[128:192], out[192:] = 10, 9  # 10: continuation bytes, not counted
    return out


_CLASS = _classes()
_LIST = sorted({w for ws in COMMON.values() for w in ws})
FEATURES = (
    "key long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, chars array<int>, common array<int>"
)


def _listed() -> tuple[np.ndarray, np.ndarray]:
    w = words(pa.array([" ".join(_LIST)]))
    h = w.hashes()
    order = np.argsort(h)
    return h[order], order


_LIST_HASH, _LIST_AT = _listed()


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and histograms of each text of a slice."""
    n = len(texts)
    w = words(texts)
    bounds = np.append(w.text_start, len(w.data))
    kinds = _CLASS[w.data]
    row_of_byte = np.repeat(np.arange(n), np.diff(bounds))
    chars = np.bincount(row_of_byte * 11 + kinds, minlength=n * 11).reshape(n, 11)[:, :CLASSES]
    solid_starts = (kinds != 10) & ~np.isin(w.data, np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8))
    h = w.hashes()
    # Words in windows of five that the text holds more than once.
    g, at = grams(h, w, 5)
    row = w.row[at]
    order = np.lexsort((g, row))
    same = np.zeros(len(g), bool)
    if len(g) > 1:
        pair = (g[order][1:] == g[order][:-1]) & (row[order][1:] == row[order][:-1])
        same[order[1:]] |= pair
        same[order[:-1]] |= pair
    covered = np.zeros(len(h) + 1, np.int64)
    np.add.at(covered, at[same], 1)
    np.add.at(covered, at[same] + 5, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    # Lines with a word that equal an earlier line of the text.
    begin, end, line_row = lines(w)
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, line_row = begin[has_word], end[has_word], line_row[has_word]
    lh = span_hashes(w.data, begin, end)
    order = np.lexsort((begin, lh, line_row))
    later = np.zeros(len(lh), bool)
    if len(lh) > 1:
        later[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    # Common words, as written or with a capital.
    low = words(texts, lower=True).hashes()
    found = np.searchsorted(_LIST_HASH, low)
    found[found == len(_LIST_HASH)] = 0
    hit = _LIST_HASH[found] == low
    common_counts = np.bincount(w.row[hit] * len(_LIST) + _LIST_AT[found[hit]], minlength=n * len(_LIST)).reshape(n, len(_LIST))
    return {
        "n_words": w.counts,
        "word_chars": by_row(solid_starts, bounds),
        "n_symbols": by_row(kinds == 7, bounds),
        "n_dup_lines": np.bincount(line_row[later], minlength=n),
        "n_repeat_words": by_row(repeat, w.first),
        "chars": chars,
        "common": common_counts,
    }


def features(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b):
                m = measure(s.column(2))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(m[k].astype(np.int32).ravel()), m[k].shape[1]).cast(pa.list_(pa.int32())) for k in ("chars", "common")]
                counts = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.record_batch([s.column(0), s.column(1), *counts, *lists], _NAMES)

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return common.mapped(chosen, run, FEATURES)


_NAMES = ["key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"]


def _shares(column: str, keep: list[int] | None = None) -> F.Column:
    """A histogram as shares; ``keep`` picks bins and adds one for the rest of the words."""
    c = F.col(column)
    if keep is None:
        total = F.greatest(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
        return F.transform(c, lambda x: x / total)
    picked = F.array(*[F.get(c, F.lit(i)).cast("double") for i in keep])
    rest = F.greatest(F.col("n_words") - F.aggregate(picked, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return F.transform(F.concat(picked, F.array(rest)), lambda x: x / F.greatest(F.col("n_words"), F.lit(1)))


def distance(p: F.Column, q: F.Column) -> F.Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""

    def half(a: F.Column, b: F.Column) -> F.Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def rules(
    docs: DataFrame,
    max_char_distance: float = 0.3,
    max_word_distance: float = 0.34,
    min_chars: int = 400,
    min_words: int = 100,
    text: str = "text",
    key: str = "doc_id",
    lang: str = "lang",
) -> DataFrame:
    """Rows (key, counts, base_failed, char_distance, word_distance, kept) of ``docs``."""
    rows = common.written(features(docs, text, key, lang), "rules")
    known = F.col("lang").isin(*COMMON)
    rows = rows.withColumn("profile", F.when(known, F.col("lang")).otherwise("other"))
    word_shares = F.lit(None).cast("array<double>")
    for code, listed in COMMON.items():
        word_shares = F.when(F.col("profile") == code, _shares("common", [_LIST.index(w) for w in listed])).otherwise(word_shares)
    rows = (
        rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("char_shares", _shares("chars"))
        .withColumn("word_shares", word_shares)
    )
    good = rows.where(~F.col("base_failed") & (F.col("n_words") >= min_words))
    longest = max(map(len, COMMON.values())) + 1
    mean = lambda c, n: F.array(*[F.coalesce(F.avg(F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))), F.lit(0.0)) for i in range(n)])
    reference = good.groupBy("profile").agg(mean("char_shares", CLASSES).alias("char_reference"), mean("word_shares", longest).alias("word_reference"))
    # At most one row per listed language and one more: a proven bound for the broadcast.
    judged = rows.join(F.broadcast(reference), "profile", "left")
    padded = F.slice("word_reference", F.lit(1), F.size("word_shares"))
    judged = judged.withColumn("char_distance", F.coalesce(distance(F.col("char_shares"), F.col("char_reference")), F.lit(0.0)))
    judged = judged.withColumn("word_distance", F.when(F.col("word_shares").isNull(), 0.0).otherwise(F.coalesce(distance(F.col("word_shares"), padded), F.lit(0.0))))
    far = ((F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance)) | (
        (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance)
    )
    return judged.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance",
    )
