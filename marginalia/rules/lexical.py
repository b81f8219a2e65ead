"""Per-document rules over sentences, headings and links.

``Sentences`` have (doc, idx, block, section, start, stop, language, heading,
quoted, example, runs, coded, fragments), as the shredder gives them. A rule
returns rows (doc, code, start, stop); what it cannot decide it returns as
incomplete rows (doc, code).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

_SEPARATED = r"[\s:=#]"


def by_language(lexicon: dict[str, list[str]], use: Callable[[str], Column], extra: dict[str, Iterable[str]] | None = None) -> Column:
    """``use(pattern)`` of the phrases of each row's language."""
    out = F.lit(None)
    for code, phrases in lexicon.items():
        pattern = T.phrase_pattern([*phrases, *(extra or {}).get(code, [])])
        out = F.when(F.col("language") == code, use(pattern)).otherwise(out)
    return out


def found(s: DataFrame, code: str, span: Column) -> DataFrame:
    """Rows whose span is not null, as diagnostics."""
    rows = s.select("doc", F.lit(code).alias("code"), span.alias("span")).where("span is not null")
    return rows.select("doc", "code", F.col("span.start").cast("long").alias("start"), F.col("span.stop").cast("long").alias("stop")).distinct()


def _any(runs: Column, pattern: str) -> Column:
    return F.exists(runs, lambda r: r["text"].rlike(pattern))


def _constrained(extra: dict | None = None) -> Column:
    coded = F.col("coded")
    return F.coalesce(by_language(L.CONSTRAINT, lambda p: _any(coded, p), extra), F.lit(False)) | _any(coded, L.BOUND)


def stale_values(s: DataFrame, extra: dict | None = None) -> DataFrame:
    """STL001: a stale marker and a value that can change, without a constraint."""
    extra = extra or {}
    marked = by_language(L.STALE, lambda p: _any(F.col("runs"), p), extra.get("stale"))
    value = T.run_marker(F.col("coded"), rf"(?<![A-Za-z0-9_])(?>{L.VALUE})(?![A-Za-z0-9_])")
    return found(s.where(F.coalesce(marked, F.lit(False)) & ~_constrained(extra.get("constraint"))), "STL001", value)


def commit_hashes(s: DataFrame, extra: dict | None = None) -> DataFrame:
    """STL003: a commit word, separated from the hash that follows it."""
    frames = []
    for code, phrases in L.COMMIT.items():
        every = [*phrases, *((extra or {}).get("commit") or {}).get(code, [])]
        words = [p for p in every if p[-1].isascii() and p[-1].isalnum()]
        signs = [p for p in every if p not in words]
        part = lambda ps, sep: f"(?:{T.phrase_pattern(ps)}){_SEPARATED}{sep}"
        lead = "|".join([part(words, "+"), *([part(signs, "*")] if signs else [])])
        pattern = rf"(?:{lead})[a-fA-F0-9]{{7,40}}(?=$|[^a-zA-Z0-9_])"
        rows = s.where((F.col("language") == code) & _any(F.col("coded"), pattern))
        rows = rows.select("doc", F.explode("coded").alias("run")).select("doc", "run", F.explode(T.occurrences(F.col("run.text"), pattern)).alias("hit"))
        size = F.length(F.regexp_extract(F.substring(F.col("run.text"), F.col("hit.start") + 1, F.col("hit.end") - F.col("hit.start")), r"([a-fA-F0-9]{7,40})$", 1))
        frames.append(found(rows, "STL003", T.source_span(F.col("run.pieces"), F.col("hit.end") - size, F.col("hit.end"))))
    return _union(frames).distinct()


def root_pointers(s: DataFrame, links: DataFrame, extra: dict | None = None) -> DataFrame:
    """PTR001: a pointer word beside a link to a repository's root. ``links`` say ``root`` for local ones."""
    marked = by_language(L.POINTER, lambda p: _any(F.col("runs"), p), (extra or {}).get("pointer"))
    told = s.where(F.coalesce(marked, F.lit(False))).select("doc", "block", F.col("start").alias("a"), F.col("stop").alias("z"))
    rooted = links.where(~F.col("image") & (T.repository_root(F.col("destination")) | F.col("root")))
    met = rooted.join(told, ["doc", "block"]).where("a < stop and start < z")
    span = F.when(F.col("reference"), F.struct("start", "stop")).otherwise(F.struct(F.col("dest_start").alias("start"), F.col("dest_stop").alias("stop")))
    return found(met, "PTR001", span)


def source_pointers(s: DataFrame, extra: dict | None = None) -> DataFrame:
    """PTR003: a pointer to the source in a sentence that names no file or symbol."""
    span = by_language(L.SOURCE, lambda p: T.run_marker(F.col("runs"), p), (extra or {}).get("source"))
    return found(s.where(~F.exists("fragments", specific)), "PTR003", span)


def specific(f: Column) -> Column:
    """Whether a fragment names a file, a symbol or a place in a document."""
    file = rf"(?i)(?:^|[^a-z0-9_.-])(?:[a-z0-9_@.+-]+[/\\])*[a-z0-9_@+-]+\.(?:{'|'.join(L.SOURCE_EXTENSIONS)})(?:$|[^a-z0-9_.-]|\.(?:$|\s))"
    symbol = (
        r"\b(?:[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+|[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+|[A-Za-z_][A-Za-z0-9_]*\(\)"
        r"|[A-Z][a-z]+[A-Z][A-Za-z0-9]*|[A-Z][A-Z0-9_]{2,})(?:$|[^\p{L}\p{N}_])"
    )
    text = F.trim(f["text"])
    path = F.regexp_extract(text, r"^([^?#]*)", 1)
    target = F.when(F.startswith(text, F.lit("#")), F.length(text) > 1).otherwise(
        path.rlike(file) | F.substring_index(path, "/", -1).isin(*L.SOURCE_FILES) | text.rlike("^[^#]*#.")
    )
    shown = F.regexp_replace(text, r"(?i)(?:[a-z][a-z0-9+.-]*://|www\.)[^\s<>]+", " ")
    code = (f["kind"] == "inline_code") & (text.isin(*L.SOURCE_FILES[:3]) | text.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    return F.when(f["kind"] == "link_destination", target).otherwise(shown.rlike(file) | shown.rlike(symbol) | code)


def rationale_headings(s: DataFrame, extra: dict | None = None) -> DataFrame:
    """RAT002: a heading that begins with a choice's reason."""
    first = by_language(L.RATIONALE, lambda p: T.run_marker(F.col("runs"), rf"(?<=^\s{{0,32}})(?:{p})"), (extra or {}).get("rationale"))
    choice = F.when(F.col("language") == "ja", T.run_marker(F.col("runs"), L.JAPANESE_CHOICE))
    return found(s.where("heading"), "RAT002", F.coalesce(first, choice))


def conversation(s: DataFrame, extra: dict | None = None) -> DataFrame:
    """VOX001: the text answers its requester; clauses about a product's own users do not."""
    frames = []
    for code, phrases in L.CONVERSATION.items():
        pattern = T.phrase_pattern([*phrases, *((extra or {}).get("conversation") or {}).get(code, [])])
        rows = s.where((F.col("language") == code) & _any(F.col("runs"), pattern))
        rows = rows.select("doc", "idx", F.explode("runs").alias("run")).select("doc", "idx", "run", F.explode(T.occurrences(F.col("run.text"), pattern)).alias("hit"))
        text = F.col("run.text")
        before, after = F.substring(text, F.lit(1), F.col("hit.start")), F.substring(text, F.col("hit.end") + 1, F.length(text))
        rows = rows.where(~end_users(before, after)).withColumn("span", T.source_span(F.col("run.pieces"), F.col("hit.start"), F.col("hit.end")))
        rows = rows.groupBy("doc", "idx").agg(F.min("span").alias("span"))
        frames.append(found(rows, "VOX001", F.col("span")))
    return _union(frames)


def end_users(before: Column, after: Column) -> Column:
    """Whether a clause or the words around a phrase make it a condition or a requirement."""
    before = F.regexp_replace(before, r"\s+$", "")
    clause = F.regexp_extract(before, rf"([^{L.CLAUSE_BOUNDARIES}]*)$", 1)
    words = F.split(F.lower(clause), r"[^\p{IsAlphabetic}\p{N}]+")
    return (
        before.rlike(f"(?:{'|'.join(L.END_USER_ADJACENT)})$") | clause.rlike("|".join(L.END_USER_CLAUSE))
        | F.arrays_overlap(words, F.array(*map(F.lit, L.END_USER_WORDS))) | F.regexp_replace(after, r"^\s+", "").rlike(f"^(?:{'|'.join(L.END_USER_AFTER)})")
    )


def asserting(s: DataFrame) -> DataFrame:
    """Sentences outside quotes and examples, with what they assert."""
    rows = s.where(~F.col("quoted") & ~F.col("example"))
    return rows.withColumn("said", T.joined(F.col("runs"), "asserted")).withColumn("said_coded", T.joined(F.col("coded"), "asserted"))


def deployment(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STL002: a state of deployment, not conditional; in English undecided without a word for the state."""
    span = by_language(L.DEPLOYMENT, lambda p: T.run_marker(F.col("runs"), p, "asserted"))
    rows = asserting(s).where(~T.conditional(F.col("said"))).withColumn("span", span).where("span is not null")
    state = (F.col("language") != "en") | T.contains_any(F.col("said_coded"), L.DEPLOYMENT_STATE)
    return found(rows.where(state), "STL002", F.col("span")), _open(rows.where(~state), "STL002")


def version_snapshots(s: DataFrame, extra: dict | None = None) -> DataFrame:
    """STL004: a version that a label or a state gives, neither constrained nor in context."""
    rows = asserting(s).where(~_constrained((extra or {}).get("constraint")) & ~T.conditional(F.col("said")) & ~T.contains_any(F.col("said"), L.VERSION_CONTEXT))
    rows = rows.withColumn("stated", T.contains_any(F.col("said"), L.VERSION_STATE)).withColumn("worded", T.contains_any(F.col("said"), L.VERSION_WORDS))
    rows = rows.where(F.col("stated") | F.exists("coded", lambda r: r["asserted"].rlike(L.VERSION_LABEL)))
    rows = rows.select("doc", "stated", "worded", F.explode("coded").alias("run"))
    text = F.col("run.asserted")
    rows = rows.withColumn("label", text.rlike(L.VERSION_LABEL)).where((F.col("label") | F.col("stated")) & ~text.rlike(L.COMPARISON))
    frames = []
    for label, left in ((True, r"(?<![\p{IsAlphabetic}\p{N}_./\\-])"), (False, r"(?<![\p{IsAlphabetic}\p{N}_./\\:-])")):
        pattern = rf"{left}(?>{L.VERSION})(?![\p{{IsAlphabetic}}\p{{N}}_/\\]|\.[\p{{IsAlphabetic}}\p{{N}}])"
        hits = rows.where(F.col("label") == label).select("doc", "run", "worded", F.explode(T.occurrences(F.col("run.asserted"), pattern)).alias("hit"))
        value = F.substring(F.col("run.asserted"), F.col("hit.start") + 1, F.lit(1))
        hits = hits.where(F.col("worded") | value.isin("v", "V"))
        frames.append(found(hits, "STL004", T.source_span(F.col("run.pieces"), F.col("hit.start"), F.col("hit.end"))))
    return _union(frames)


def excluded_scope(s: DataFrame) -> DataFrame:
    """VOX002: a heading about what is left out."""
    return found(asserting(s).where("heading"), "VOX002", by_language(L.EXCLUDED_HEADING, lambda p: T.run_marker(F.col("runs"), p, "asserted")))


def narration(s: DataFrame) -> DataFrame:
    """VOX003: headings and first-person accounts of the making."""
    headed = by_language(L.PRODUCTION_HEADING, lambda p: T.run_marker(F.col("runs"), p, "asserted"))
    told = by_language(L.NARRATION, lambda p: T.run_marker(F.col("runs"), p, "asserted"))
    return found(asserting(s), "VOX003", F.when(F.col("heading"), headed).otherwise(told))


def evaluations(s: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EVD001: an evaluation without evidence in its block or the one before or after it.

    Neighbours are blocks of the same section and parent, counted without
    quotes, headings, comments and breaks. A mere recommendation may rest on a
    reason in its own block or on a procedure that follows; else it is undecided.
    """
    rows = asserting(s).where(~F.col("heading") & ~T.conditional(F.col("said")))
    rows = rows.withColumn("span", by_language(L.EVALUATION, lambda p: T.run_marker(F.col("runs"), p, "asserted"))).where("span is not null")
    rows = rows.withColumn("hit", by_language(L.EVALUATION, lambda p: T.first_match(F.col("said"), p)))
    before = F.regexp_extract(F.substring(F.col("said"), F.lit(1), F.col("hit.start")), r"(\S)\s*$", 1)
    after = F.regexp_extract(F.substring(F.col("said"), F.col("hit.end") + 1, F.length("said")), r"^\s*(\S)", 1)
    rows = rows.where(~(before.isin(*",，、(（") & after.isin(*",，、)）")))
    place = Window.partitionBy("doc", "section", "parent").orderBy("start")
    content = blocks.where(~F.col("quoted") & ~F.col("kind").isin("heading", "comment", "break"))
    near = content.select(
        "doc", F.col("idx").alias("block"), "prose",
        (F.col("evidence") | F.coalesce(F.lag("evidence").over(place), F.lit(False)) | F.coalesce(F.lead("evidence").over(place), F.lit(False))).alias("near"),
        F.coalesce(F.lead("flow").over(place), F.lit(False)).alias("then"),
    )
    rows = rows.join(near, ["doc", "block"], "left")
    advice = T.contains_any(F.col("said"), L.RECOMMENDATION) & ~T.contains_any(F.col("said"), L.COMPARISON_WORDS)
    shown = F.coalesce("near", F.lit(False)) | (advice & (F.coalesce("then", F.lit(False)) | T.contains_any(F.coalesce("prose", F.lit("")), L.REASONS)))
    rows = rows.where(~shown)
    generic = advice & ~T.contains_any(F.col("said"), L.PREFERENCE_WORDS)
    return found(rows.where(~generic), "EVD001", F.col("span")), _open(rows.where(generic), "EVD001")


def _open(rows: DataFrame, code: str) -> DataFrame:
    return rows.select("doc", F.lit(code).alias("code")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def run(sentences: DataFrame, blocks: DataFrame, links: DataFrame, codes: set[str], languages: Iterable[str] = ("en", "zh", "ja"), extra: dict | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Diagnostics and incomplete rows of the named rules; STL001 yields to STL003 and STL004 on the same span.

    ``extra`` adds phrases: {stale, constraint, commit, pointer, source, rationale, conversation} by language.
    """
    s = sentences.where(F.col("language").isin(*languages))
    plain = {
        "STL001": lambda: stale_values(s, extra), "STL003": lambda: commit_hashes(s, extra), "PTR001": lambda: root_pointers(s, links, extra),
        "PTR003": lambda: source_pointers(s, extra), "RAT002": lambda: rationale_headings(s, extra), "VOX001": lambda: conversation(s, extra),
        "STL004": lambda: version_snapshots(s, extra), "VOX002": lambda: excluded_scope(s), "VOX003": lambda: narration(s),
    }
    found_rows = [rule() for code, rule in plain.items() if code in codes]
    undecided = []
    for code, rule in (("STL002", lambda: deployment(s)), ("EVD001", lambda: evaluations(s, blocks))):
        if code in codes:
            rows, left = rule()
            found_rows.append(rows)
            undecided.append(left)
    out = _union(found_rows) if found_rows else None
    if "STL001" in codes and codes & {"STL003", "STL004"}:
        stronger = out.where("code in ('STL003', 'STL004')").select("doc", "start", "stop", F.lit("STL001").alias("code"))
        out = out.join(stronger, ["doc", "start", "stop", "code"], "left_anti")
    return out, _union(undecided) if undecided else None
