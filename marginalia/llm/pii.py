"""Personal data: pattern spans and information-theoretic sanitisation.

Base spans are e-mail and IP addresses, card and phone numbers; keys and other
secrets are entities too, with spans of their own. Beyond them, terms that
reveal such an entity are sanitised: the corpus tells in how
many distinct texts a term stands beside an entity, and in how many at all.
With N texts, n(k) of them holding k, a kind or one entity of it, the share

    disclosure(t, k) = pmi(t, k) / ic(k)
    pmi = log2(n(t, k) * N / (n(t) * n(k))),  ic = -log2(n(k) / N)

says how much of the entity's information the term gives away: 1 if the term
never occurs without it. From ``generalise_at`` on, the term is replaced by
its kind's name wherever it stands, with or without the entity; from ``remove_at`` on it is
removed. A term must stand beside the kind or entity in ``min_texts`` distinct
texts, so that copies of one document are no evidence. The parts of a base
span are no terms.

Only DataFrame functions are used. Statistics cover every document. Terms
meet documents by joins on the term; nothing is broadcast by request.

Defined results: a null or empty text has no spans and stays; repeated rows
are each returned; documents that share an id keep their own spans; no rows
give no rows; all other columns are kept, and columns named like the results
(``RESULTS``) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Kinds of entities that are protected: the base kinds, and secrets.
ENTITIES = (*KINDS, "secret")
RESULTS = (*ENTITIES, "term", "redacted")
#: Possessive forms of the kinds' patterns: they match the same spans, in
#: linear time and without recursion. An address starts where a run of its
#: characters starts, or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Runs of hexadecimal digits as long as a digest, keys of known forms, and what is assigned to a name of a secret.
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9-]{20,})(?![A-Za-z0-9])"
    r"|(?<=(?i:token|secret|password|passwd|api[_-]?key)[\x20]{0,2}[:=][\x20]{0,2}[\x22\x27])[^\s\x22\x27]{8,}",
}
#: What a text must hold for the pattern to be worth a look.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": r"\+[0-9]", "secret": r"[0-9a-f]{32}|[0-9A-F]{32}|AKIA|gh[opsu]_|sk-|[:=][\x20]{0,2}[\x22\x27]"}
SPANS = "array<struct<start:int,end:int,value:string>>"
TERMS = "array<struct<start:int,end:int,value:string,kind:string,removed:boolean>>"
#: Blanks and signs between terms, after lower-casing.
_GAP = r"[\x00-\x60\x7B-\x7F]+"
_LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, pattern: Column) -> Column:
    """Spans (start, end, value) of all matches, in code points.

    Splitting and extracting scan alike, so pieces and matches alternate.
    """

    def place(s: Column) -> Column:
        def total(lengths: Column, n: Column) -> Column:
            return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda a, x: a + x)

        def span(hit: Column, i: Column) -> Column:
            start = total(s["gaps"], i + 1) + total(s["sizes"], i)
            return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"))

        return F.transform(s["hits"], span)

    def lengths(s: Column) -> Column:
        measured = F.struct(s["hits"].alias("hits"), F.transform(s["pieces"], F.length).alias("gaps"), F.transform(s["hits"], F.length).alias("sizes"))
        return let(measured, place)

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces"))
    return let(found, lengths)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    hint = F.contains(text, F.lit(HINTS[kind])) if kind == "email" else text.rlike(HINTS[kind])
    found = occurrences(text, F.lit(PATTERNS[kind]))
    return F.when(hint, F.filter(found, lambda s: valid(kind, s["value"]))).otherwise(F.array().cast(SPANS))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one array of spans per kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.drop(*RESULTS).withColumns({k: base_spans(body, k) for k in ENTITIES})


def listed(*kinds: str) -> Column:
    """Spans as kind:start:end, by kind and then start, joined by commas."""

    def part(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(part, kinds)), ",")


def outside(text: Column) -> Column:
    """The text with a line end for each base span, so that no span's own parts are terms."""
    at = F.array_sort(F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in ENTITIES]))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], between, F.lit("\n")).alias("out"))

    told = F.aggregate(at, begin, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(at) > 0, told).otherwise(text)


def terms_of(text: Column) -> Column:
    """Distinct words of three letters or more outside base spans, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(outside(text)), _GAP)), lambda w: F.length(w) >= 3)


def disclosure(n_joint: str, n_term: str, n_entity: str, n: str) -> Column:
    """Share of an entity's information that a term gives away; null where every text holds the entity."""
    pmi = F.log2(F.col(n_joint) * F.col(n) / (F.col(n_term) * F.col(n_entity)))
    ic = -F.log2(F.col(n_entity) / F.col(n))
    return F.when(ic > 0, pmi / ic)


def disclosing_terms(
    based: DataFrame, text: str = "text", min_texts: int = 8, generalise_at: float = 0.8
) -> DataFrame:
    """Rows (term, kind, disclosure) of terms that reveal a kind or one entity of it, from all of ``based``."""
    body = F.coalesce(F.col(text), F.lit(""))

    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["value"].alias("value")))

    held = F.array_distinct(F.concat(*map(of_kind, ENTITIES)))
    # Copies are folded, so that all counts are of distinct texts.
    texts = based.select(F.xxhash64(body).alias("doc"), F.array_join(terms_of(body), " ").alias("words"), held.alias("held")).dropDuplicates(["doc"])
    texts = common.written(texts, "texts", release=True)
    holds = {k: F.array_contains(F.col("held.kind"), k) for k in ENTITIES}
    count = F.count("*").alias("n")
    by_kind = F.explode(F.create_map(*[x for k in ENTITIES for x in (F.lit(k), F.col(k))]))
    kinds = texts.agg(count, *[F.count_if(c).alias(k) for k, c in holds.items()])
    term = F.explode(F.split("words", " ")).alias("term")
    frequency = texts.select(term, *[c.alias(k) for k, c in holds.items()]).where("term <> ''")
    frequency = frequency.groupBy("term").agg(F.count("*").alias("n_term"), *[F.count_if(k).alias(k) for k in ENTITIES])
    frequency = common.written(frequency.where(F.col("n_term") >= min_texts), "frequency", release=True)
    # How much a term tells of a kind.
    joint = frequency.select("term", "n_term", by_kind.alias("kind", "n_joint")).where(F.col("n_joint") >= min_texts)
    rated = joint.join(kinds.select("n", by_kind.alias("kind", "n_entity")), "kind")
    of_kinds = rated.select("term", "kind", disclosure("n_joint", "n_term", "n_entity", "n").alias("disclosure"))
    # How much it tells of one entity. Only entities of min_texts texts can have a term in as many.
    entity = texts.select("doc", F.explode("held").alias("entity"))
    common_ones = entity.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= min_texts)
    common_ones = common.written(common_ones, "entities", release=True)
    per_text = entity.join(common_ones, "entity").groupBy("doc").agg(F.collect_list(F.struct("entity", "n_entity")).alias("known"))
    both = texts.select("doc", "words").join(per_text, "doc").select(F.explode("known").alias("known"), "words").select("known", term).where("term <> ''")
    both = both.groupBy("known", "term").agg(F.count("*").alias("n_joint")).where(F.col("n_joint") >= min_texts)
    both = both.join(frequency.select("term", "n_term"), "term").join(kinds.select("n"))
    both = both.select("term", F.col("known.entity.kind").alias("kind"), F.col("known.n_entity").alias("n_entity"), "n_joint", "n_term", "n")
    of_entities = both.select("term", "kind", disclosure("n_joint", "n_term", "n_entity", "n").alias("disclosure"))
    rated = of_kinds.unionByName(of_entities).where(F.col("disclosure") >= generalise_at)
    rated = common.written(rated.groupBy("term", "kind").agg(F.max("disclosure").alias("disclosure")), "terms", release=True)
    for gone in (texts, frequency, common_ones):
        common.forget(gone)
    return rated


def sanitise(
    docs: DataFrame, text: str = "text", min_texts: int = 8, generalise_at: float = 0.8, remove_at: float = 0.95
) -> DataFrame:
    """``docs`` with spans of each kind and of terms, and the text without them."""
    based = with_base(docs, text)
    terms = disclosing_terms(based, text, min_texts, generalise_at)
    out = based
    if terms.isEmpty():
        out = out.withColumn("term", F.array().cast(TERMS))
    else:
        body = F.coalesce(F.col(text), F.lit(""))
        # Two hashes name a row; equal rows share spans.
        names = {f"_name{i}": F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in docs.columns if c in (text, "doc_id")]) for i in (1, 2)}
        out = based.withColumns(names)
        said = out.select(*names, F.explode(terms_of(body)).alias("term")).join(terms, "term")
        said = said.groupBy(*names).agg(F.collect_set(F.struct("term", "kind", (F.col("disclosure") >= remove_at).alias("removed"))).alias("said"))
        pattern = F.concat(F.lit(f"(?iu)(?<!{_LETTER})(?:"), F.array_join(F.array_distinct(F.transform("said", lambda t: t["term"])), "|"), F.lit(f")(?!{_LETTER})"))

        def apart(s: Column) -> Column:
            return ~F.exists(F.concat(*map(F.col, ENTITIES)), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

        def judged(s: Column) -> Column:
            why = F.array_sort(F.filter(F.col("said"), lambda t: t["term"] == F.lower(s["value"])))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.get(why, F.lit(0))["kind"].alias("kind"), F.coalesce(F.get(why, F.lit(0))["removed"], F.lit(False)).alias("removed"))

        spans = F.transform(F.filter(occurrences(body, pattern), apart), judged)
        out = out.join(said, list(names), "left").withColumn("term", F.when(F.col("said").isNotNull(), spans).otherwise(F.array().cast(TERMS)))
        out = out.drop("said", *names)
    return out.withColumn("redacted", redacted(F.col(text)))


def redacted(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one."""
    tag = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("tag")))
    term = F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], "").otherwise(F.concat(F.lit("["), F.upper(F.coalesce(s["kind"], F.lit("term"))), F.lit(" TERM]"))).alias("tag")))
    spans = F.array_sort(F.concat(*[tag(k) for k in ENTITIES], term))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))), s["tag"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(done["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    told = F.aggregate(spans, begin, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, told).otherwise(text)
