"""Rules that compare documents: links, repeated content and its owners.

``files`` has (doc, kind, domain, language, canonical, min_identifiers,
min_jaccard, min_paragraph_similarity, min_paragraph_chars, shingle_size).
Units have (unit, doc, start, stop, names: array of strings); edges (family, a,
b) say that a's own settings find b alike; both are of one domain and language
and of different documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import setjoin

#: Distinct shingles that a paragraph needs.
LEAST_SHINGLES = 8


def _unit(df: DataFrame, family: str) -> DataFrame:
    return df.withColumn("unit", F.xxhash64(F.lit(family), "doc", "start", "stop"))


def definition_units(shredded: DataFrame) -> DataFrame:
    """Units (unit, doc, start, stop, names, heads) of tables and lists that define identifiers."""
    rows = shredded.select("doc", F.inline("definitions"))
    return _unit(rows.withColumn("start", F.col("start").cast("long")).withColumn("stop", F.col("stop").cast("long")), "definition")


def section_units(shredded: DataFrame) -> DataFrame:
    """Units (unit, doc, start, stop, names, whole) of sections' own content and of whole documents."""
    own = lambda s: F.filter("identifiers", lambda i: i["section"] == s["idx"])
    texts = lambda a: F.array_distinct(F.transform(a, lambda i: i["text"]))
    sections = F.transform("sections", lambda s: F.struct(s["start"].cast("long").alias("start"), s["own_stop"].cast("long").alias("stop"), texts(own(s)).alias("names"), F.lit(False).alias("whole")))
    size = F.get(F.col("sections"), F.lit(0))["stop"].cast("long")
    document = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop"), texts(F.col("identifiers")).alias("names"), F.lit(True).alias("whole")))
    rows = shredded.select("doc", F.inline(F.concat(sections, document)))
    return rows.withColumn("unit", F.xxhash64(F.lit("section"), "doc", "start", "stop", "whole"))


def paragraph_units(shredded: DataFrame, files: DataFrame) -> DataFrame:
    """Units (unit, doc, start, stop, names) of paragraphs outside lists, tables and quotes: character shingles of the folded text."""
    rows = shredded.select("doc", F.inline(F.filter("blocks", lambda b: (b["kind"] == "paragraph") & ~b["listed"]))).select("doc", "start", "stop", "text")
    rows = rows.join(files.select("doc", "min_paragraph_chars", "shingle_size"), "doc").where(T.alphanumerics(F.col("text")) >= F.col("min_paragraph_chars"))
    pattern = F.concat(F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{"), F.col("shingle_size").cast("string"), F.lit("}))"))
    names = F.array_distinct(F.regexp_extract_all(T.folded(F.col("text")), pattern, F.lit(1)))
    rows = rows.withColumn("names", names).where(F.size("names") >= LEAST_SHINGLES)
    return _unit(rows.select("doc", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "names"), "paragraph")


def similar_units(units: DataFrame, files: DataFrame, threshold: str, names: str = "names", least: str | None = None) -> DataFrame:
    """Directed edges (a, b): a's document finds at least its threshold in common (and ``least`` names).

    Candidates meet at the lowest threshold of all documents, which loses none;
    each direction is then decided by its own document's settings.
    """
    known = files.select("doc", F.col(threshold).alias("t"), *([F.col(least).alias("least")] if least else [F.lit(0).alias("least")]), "shingle_size", F.xxhash64(F.coalesce("domain", F.lit("")), "language").alias("block"))
    rows = units.select("unit", "doc", F.array_distinct(names).alias("names")).where(F.size("names") > 0).join(known, "doc")
    lowest = known.agg(F.min("t")).head()[0]
    if lowest is None:
        return units.sparkSession.createDataFrame([], "a long, b long")
    ratio = Fraction(str(max(lowest, 1e-6))).limit_denominator(10**6)
    from ..operators.similarity import hashed

    sets = setjoin.counted(hashed(rows.select(F.col("unit").alias("head"), "block", F.col("names").alias("tokens")), ["block"]), ratio.numerator, ratio.denominator)
    met = setjoin.verified(setjoin.every_pair(sets, ratio.numerator, ratio.denominator), sets, ratio.numerator, ratio.denominator)
    side = lambda c: rows.select(F.col("unit").alias(c), F.col("doc").alias(f"doc_{c}"), F.col("t").alias(f"t_{c}"), F.col("least").alias(f"least_{c}"), F.col("shingle_size").alias(f"k_{c}"))
    met = met.join(side("a"), "a").join(side("b"), "b").where("doc_a <> doc_b")
    if not least:
        met = met.where("k_a = k_b")  # shingles of unlike length do not compare
    good = lambda c: (F.col("shared") >= F.col(f"least_{c}")) & (F.col("shared") / F.col("total") >= F.col(f"t_{c}"))
    return met.where(good("a")).select("a", "b").unionByName(met.where(good("b")).select(F.col("b").alias("a"), F.col("a").alias("b")))


def restatements(units: DataFrame, links: DataFrame, anchors: DataFrame, files: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between a section that ends in a link and what it links to, and incomplete documents (doc).

    ``links`` are resolved: (doc, start, stop, image, status, target, anchor);
    ``anchors`` has (filename, anchor, start, stop), ``docs`` (doc, text). The
    linked unit is the smallest section around the anchor, or the whole document.
    """
    own = units.where("not whole").join(files.select("doc", "min_identifiers", "min_jaccard", "domain", "language"), "doc").where(F.size("names") >= F.col("min_identifiers"))
    l = links.where("not image").select("doc", F.col("start").alias("l_start"), F.col("stop").alias("l_stop"), "status", "target", "anchor")
    last = own.join(l, "doc").where("start <= l_start and l_stop <= stop")
    last = last.groupBy("unit").agg(F.max_by(F.struct("doc", "stop", "names", "min_identifiers", "min_jaccard", "domain", "language", "l_stop", "status", "target", "anchor"), F.struct("l_stop", "l_start")).alias("x")).select("unit", "x.*")
    last = last.join(docs.select("doc", F.col("text").alias("_text")), "doc")
    tail = F.decode(F.substring(F.encode("_text", "UTF-8"), (F.col("l_stop") + 1).cast("int"), (F.col("stop") - F.col("l_stop")).cast("int")), "UTF-8")
    last = last.where(tail.rlike(r"^[\s.。!！?？;；]*$")).drop("_text")
    undecided = last.where(F.col("status").isin("unknown", "template", "outside")).select("doc").distinct()
    there = files.select(F.col("doc").alias("target"), F.col("domain").alias("d"), F.col("language").alias("g"))
    found = last.where(F.col("status").isin("file", "anchor_found") & (F.col("doc") != F.col("target"))).join(there, "target")
    found = found.where((F.coalesce("domain", F.lit("")) == F.coalesce("d", F.lit(""))) & (F.col("language") == F.col("g")))
    spots = anchors.where("anchor is not null").select(F.col("filename").alias("target"), "anchor", F.col("start").alias("h_start"), F.col("stop").alias("h_stop"))
    other = units.select(F.col("unit").alias("b"), F.col("doc").alias("target"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), F.col("names").alias("theirs"), "whole")
    at = found.where("status = 'anchor_found'").join(spots, ["target", "anchor"]).join(other.where("not whole"), "target").where("b_start <= h_start and h_stop <= b_stop")
    at = at.groupBy("unit").agg(F.min_by(F.struct("b", "names", "theirs", "min_identifiers", "min_jaccard"), F.struct(F.col("b_stop") - F.col("b_start"), "b_start")).alias("x")).select("unit", "x.*")
    whole = found.where("status = 'file'").join(other.where("whole"), "target").select("unit", "b", "names", "theirs", "min_identifiers", "min_jaccard")
    shared = F.size(F.array_intersect("names", "theirs"))
    good = at.unionByName(whole).where((shared >= F.col("min_identifiers")) & (shared / F.size("names") >= F.col("min_jaccard")))
    edges = good.select(F.col("unit").alias("a"), "b")
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), undecided


def ranks(files: DataFrame) -> Column:
    """The rank of a document as an owner; the highest keeps what others repeat."""
    out = F.lit(1)
    for kind, rank in L.KIND_RANK.items():
        out = F.when(F.col("kind") == kind, rank).otherwise(out)
    return F.when(F.col("canonical"), 7).otherwise(out)


def owned(edges: DataFrame, units: DataFrame, files: DataFrame) -> DataFrame:
    """Diagnostics (doc, code, start, stop, related) of edges (family, a, b).

    A unit with alike units in documents of higher rank is reported under its
    family's code with those; one with none but some of its own rank under
    OWN002. One row per span and code: what different families relate is merged.
    """
    ranked = units.select("unit", "doc", "start", "stop").join(files.select("doc", ranks(files).alias("rank")), "doc")
    mine = ranked.select(F.col("unit").alias("a"), "doc", "start", "stop", F.col("rank").alias("own"))
    theirs = ranked.select(F.col("unit").alias("b"), F.struct(F.col("doc").alias("filename"), "start", "stop").alias("peer"), F.col("rank").alias("their"))
    met = edges.join(mine, "a").join(theirs, "b").where("their >= own")
    top = met.groupBy("family", "a").agg(F.max(F.col("their") > F.col("own")).alias("beaten"))
    met = met.join(top, ["family", "a"]).where("beaten = (their > own)")
    rows = met.withColumn("code", F.when(F.col("beaten"), F.col("family")).otherwise("OWN002"))
    return rows.groupBy("doc", "code", "start", "stop").agg(F.array_sort(F.collect_set("peer")).alias("related"))


def link_rules(resolved: DataFrame, catalogs: DataFrame) -> DataFrame:
    """LNK001, LNK002 and PTR002 on resolved links (doc, start, stop, state, existing, status, target); ``catalogs`` has (path)."""
    gone = resolved.where("state = 'local'").where(F.col("existing.status").isin("missing", "case_mismatch")).withColumn("code", F.lit("LNK001"))
    lost = resolved.where("status = 'anchor_missing'").withColumn("code", F.lit("LNK002"))
    folders = resolved.where("status = 'directory'").join(catalogs.select(F.col("path").alias("target")), "target", "left_anti").withColumn("code", F.lit("PTR002"))
    chosen = lambda d: d.select("doc", "code", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "destination", "target")
    return chosen(gone).unionByName(chosen(lost)).unionByName(chosen(folders))


def undecided_links(resolved: DataFrame) -> DataFrame:
    """Incomplete rows (doc, code) of the link rules: destinations that nothing here can decide."""
    local = F.when((F.col("state").isin("template", "outside", "unknown")) | F.col("existing.status").isin("unknown"), F.lit("LNK001"))
    vague = F.col("status").isin("template", "outside")
    codes = F.array(local, F.when(vague | (F.col("status") == "unknown"), F.lit("LNK002")), F.when(vague | ((F.col("status") == "unknown") & F.col("target").isNull()), F.lit("PTR002")))
    return resolved.select("doc", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")).distinct()
