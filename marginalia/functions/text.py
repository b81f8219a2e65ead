"""Text expressions: phrases, languages, slugs, sentences, shingles, paths.

All are Column builders that stay in the JVM. Lengths and positions count code
points unless a name says bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons

_WORD = r"[\p{L}\p{N}_]"


def phrase_pattern(phrases: Iterable[str]) -> str:
    """Matches any phrase, the shortest first, ASCII case aside; an ASCII letter or digit at its edge must end a word."""
    # Phrases with the same edges share one look at the characters around them.
    groups: dict[tuple[str, str], list[str]] = {}
    for p in sorted((p.strip() for p in phrases), key=len):
        left = rf"(?<!{_WORD})" if re.match(r"[A-Za-z0-9]", p) else ""
        right = rf"(?!{_WORD})" if re.search(r"[A-Za-z0-9]$", p) else ""
        groups.setdefault((left, right), []).append(f"\\Q{p}\\E")
    parts = [f"{left}(?:{'|'.join(ps)}){right}" for (left, right), ps in groups.items()]
    return f"(?i)(?:{'|'.join(parts)})"


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    return text.rlike(phrase_pattern(phrases))


def occurrences(text: Column, pattern: str) -> Column:
    """Spans (start, end) of a pattern's matches: pieces and matches alternate."""

    def spans(x: Column) -> Column:
        total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, v: s + v)

        def span(size: Column, i: Column) -> Column:
            start = total(x["gaps"], i + 1) + total(x["sizes"], i)
            return F.struct(start.alias("start"), (start + size).alias("end"))

        return F.transform(x["sizes"], span)

    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    return F.get(F.transform(F.array(F.struct(gaps.alias("gaps"), sizes.alias("sizes"))), spans), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value written and computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_match(text: Column, pattern: str) -> Column:
    """Span (start, end) of a pattern's first match, or null; one pass finds it, one more places it."""

    def place(hit: Column) -> Column:
        before = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
        return F.when(hit != "", let(before, lambda b: F.struct(b.alias("start"), (b + F.length(hit)).alias("end"))))

    return let(F.regexp_extract(text, pattern, 0), place)


def marker(text: Column, phrases: Iterable[str]) -> Column:
    """The earliest occurrence, or null."""
    return first_match(text, phrase_pattern(phrases))


def source_span(pieces: Column, start: Column, end: Column) -> Column:
    """The source bytes (start, stop) of a run's characters, through its pieces; null where none are in it."""

    def cut(p: Column) -> Column:
        def inside(x: Column) -> Column:
            exact = F.octet_length(p["text"]) == p["stop"] - p["start"]
            upto = lambda n: p["start"] + F.octet_length(F.substring(p["text"], F.lit(1), n))
            whole, part = F.struct(p["start"].alias("start"), p["stop"].alias("stop")), F.struct(upto(x["lo"]).alias("start"), upto(x["hi"]).alias("stop"))
            return F.when(x["lo"] < x["hi"], F.when(exact, part).otherwise(whole))

        bounds = F.struct(F.greatest(start - p["at"], F.lit(0)).alias("lo"), F.least(end - p["at"], F.length(p["text"])).alias("hi"))
        return let(bounds, inside)

    def around(cuts: Column) -> Column:
        span = F.struct(F.array_min(F.transform(cuts, lambda c: c["start"])).alias("start"), F.array_max(F.transform(cuts, lambda c: c["stop"])).alias("stop"))
        return F.when(F.size(cuts) > 0, span)

    return let(F.filter(F.transform(pieces, cut), lambda c: c.isNotNull()), around)


def run_markers(runs: Column, pattern: str, field: str = "text") -> Column:
    """Source spans of the first match in each run that has one, in order."""

    def place(r: Column) -> Column:
        return let(first_match(r[field], pattern), lambda hit: F.when(hit.isNotNull(), source_span(r["pieces"], hit["start"], hit["end"])))

    return F.array_sort(F.filter(F.transform(runs, place), lambda x: x.isNotNull()))


def run_marker(runs: Column, pattern: str, field: str = "text") -> Column:
    """The earliest source span of a match over all runs, or null."""
    return F.get(run_markers(runs, pattern, field), F.lit(0))


def joined(runs: Column, field: str = "text") -> Column:
    return F.array_join(F.transform(runs, lambda r: r[field]), " ")


def conditional(text: Column) -> Column:
    return contains_any(text, lexicons.CONDITIONAL)


def constrained(text: Column, language: str = "en") -> Column:
    return contains_any(text, lexicons.CONSTRAINT[language]) | text.rlike(lexicons.BOUND)


def line_spans(text: Column) -> Column:
    """Lines as (content, end octets): ends are CR, LF or CRLF, and the last line has none."""
    ends = F.transform(F.regexp_extract_all(text, F.lit(r"\r\n|\r|\n"), F.lit(0)), F.octet_length)
    return F.arrays_zip(F.split(text, r"\r\n|\r|\n", -1).alias("content"), ends.alias("end"))


def language(text: Column) -> Column:
    """ja or zh where Han and kana outnumber Latin words, else en."""
    kana = F.regexp_count(text, F.lit(r"[\x{3040}-\x{30ff}\x{ff66}-\x{ff9f}]"))
    han = F.regexp_count(text, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{20000}-\x{323af}]"))
    latin = F.regexp_count(text, F.lit(r"[A-Za-z]+"))
    return F.when(kana + han > latin, F.when(kana > 0, "ja").otherwise("zh")).otherwise("en")


def slug(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc} \-]", "")
    return F.replace(kept, F.lit(" "), F.lit("-"))


def sentences(text: Column) -> Column:
    """Trimmed sentences: a break follows 。！？, and .!? before white space or the end."""
    parts = F.split(text, r"(?<=[。！？])|(?<=[.!?])(?=\s|\z)")
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def folded(text: Column) -> Column:
    """Lower case, white space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def alphanumerics(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", ""))


def shingles(text: Column, k: int) -> Column:
    """Distinct runs of k characters; a match may not start inside a surrogate pair."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?![\\x{{DC00}}-\\x{{DFFF}}])(?=(.{{{k}}}))"), F.lit(1)))


def percent_decoded(text: Column) -> Column:
    """Strict decoding: a broken escape or one that is not UTF-8 gives null, and + stays."""
    told = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    broken = F.contains(told, F.lit("\ufffd")) & ~F.lower(text).rlike("%ef%bf%bd|\ufffd")
    return F.when(~broken, told)


def normal_path(path: Column) -> Column:
    """Resolves . and .. by name; leading .. stay."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (part == "..") & (F.size(done) > 0) & (last != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def has_scheme(destination: Column) -> Column:
    return destination.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def is_template(destination: Column) -> Column:
    return destination.rlike(r"[\x00{}$<>]")


def repository_root(url: Column) -> Column:
    """Whether an absolute link names a code host's repository and nothing inside it."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/]*)/", 1))
    path = F.regexp_extract(url, r"^(?i:https?)://[^/]*/(.*)$", 1)
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")
    owner, known = F.lower(F.get(parts, F.lit(0))), F.lit(False)
    for forge, reserved in lexicons.FORGES.items():
        known = F.when(host == forge, ~owner.isin(*reserved)).otherwise(known)
    return known & ~url.rlike("[#?{}$]") & (F.size(parts) == 2) & F.forall(parts, lambda p: p != "")


def git_blob(content: Column) -> Column:
    """The SHA-1 by which a version store names a file's content (binary or text)."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))
