"""The whole check: from files and configurations to diagnostics.

``files`` has (filename, text). Rules that no file enables are not planned.
Tables that several steps read are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import forget, written
from ..operators import edits, links, policy, suppress
from ..rules import across, lexical, registry, structure
from ..sources import markdown
from . import config

_LEXICAL = {"STL001", "STL002", "STL003", "STL004", "PTR001", "PTR003", "RAT002", "VOX001", "VOX002", "VOX003", "EVD001"}
_STRUCTURE = {"RAT001", "ORD001", "ORD002", "MIX001"}
_LINKS = {"LNK001", "LNK002", "PTR002"}
_SHARED = {"DUP001", "DUP002", "DUP003", "OWN001", "OWN002"}
_NEED_LINKS = _LINKS | {"PTR001", "DUP002", "OWN002"}


@dataclass
class Report:
    """Frames keyed by doc: diagnostics in no order, incomplete (doc, code), suppression states, edits, and the tables behind them."""

    diagnostics: DataFrame
    incomplete: DataFrame
    suppressions: suppress.Suppressed
    edits: DataFrame
    policies: DataFrame
    enabled: DataFrame
    shredded: DataFrame
    links: DataFrame | None
    tables: list[DataFrame]

    def forget(self) -> None:
        """Deletes the tables behind the report, once nothing reads it any more."""
        for df in self.tables:
            forget(df)


def _glob(column: Column, globs: list[str]) -> Column:
    return column.rlike("|".join(map(policy.glob_pattern, globs))) if globs else F.lit(False)


def _mapped(column: Column, rows: list[dict], value: str) -> Column:
    return policy.last_match(column, [(policy.glob_pattern(m["path"]), m[value]) for m in rows if m.get(value) is not None])


def policies(files: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """Rows (doc, config, included, excluded, mapped, domain, site_*, settings) by the nearest configuration above each file."""
    out = None
    folders = sorted(configs, key=len)
    nearest = F.lit("")
    for f in folders[1:]:
        nearest = F.when(F.startswith("filename", F.lit(f + "/")), F.lit(f)).otherwise(nearest)
    rows = files.select("filename").withColumn("config", nearest)
    for f in folders:
        s = configs[f]
        path = F.col("filename") if not f else F.substring("filename", len(f) + 2, 1 << 20)
        above = F.lit(f + "/" if f else "")
        site = lambda c, s=s, path=path: _mapped(path, [{"base": "/"} | m for m in s["sites"]], c)
        from_root = lambda c, above=above, site=site: F.regexp_replace(F.concat(above, F.regexp_replace(site(c), r"^\./|/+$", "")), r"(?:^|/)\.$", "")
        dup = s["lint"]["dup"]
        ignored = [(policy.glob_pattern(g), x) for g, ss in s["lint"]["per-file-ignores"].items() for x in ss]
        here = rows.where(F.col("config") == f).select(
            F.col("filename").alias("doc"), "config", _glob(path, s["include"]).alias("included"), _glob(path, s["exclude"]).alias("excluded"),
            _mapped(path, s["kinds"], "kind").alias("mapped"), _mapped(path, s["domains"], "name").alias("domain"),
            from_root("root").alias("site_root"), from_root("public").alias("site_public"), site("base").alias("site_base"),
            F.lit(s["preview"]).alias("preview"), F.array(*map(F.lit, s["lint"]["select"])).alias("select"), F.array(*map(F.lit, s["lint"]["ignore"])).cast("array<string>").alias("ignore"),
            F.filter(F.array(*[F.when(path.rlike(p), F.lit(x)) for p, x in ignored]).cast("array<string>"), lambda x: x.isNotNull()).alias("per_file"),
            F.lit(dup["min-identifiers"]).alias("min_identifiers"), F.lit(float(dup["min-jaccard"])).alias("min_jaccard"),
            F.lit(float(dup["min-paragraph-similarity"])).alias("min_paragraph_similarity"), F.lit(dup["min-paragraph-chars"]).alias("min_paragraph_chars"), F.lit(dup["shingle-size"]).alias("shingle_size"),
        )
        out = here if out is None else out.unionByName(here)
    return out


def enabled_rules(policies: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows (doc, code) of the rules that a file's selectors, its kind and the preview setting let run."""
    spark = policies.sparkSession
    rows = policies.select(F.col("doc").alias("filename"), "preview", "select", "ignore", "per_file")
    listed = lambda c, action: rows.select("filename", F.explode(c).alias("selector"), F.lit(action).alias("action"))
    selectors = listed("select", "select").unionByName(listed("ignore", "ignore")).unionByName(listed("per_file", "per_file"))
    chosen = policy.selected_rules(rows.select("filename", "preview"), registry.rule_table(spark), selectors)
    scoped = chosen.join(kinds.select(F.col("doc").alias("filename"), "kind"), "filename").join(F.broadcast(registry.rule_table(spark).select("code", "scope")), "code")
    fits = registry.applies(F.col("scope"), F.col("kind")) & ~F.coalesce(F.col("kind") == "generated", F.lit(False))
    return scoped.where(fits).select(F.col("filename").alias("doc"), "code")


def check(files: DataFrame, configs: dict[str, dict] | None = None, inventory: DataFrame | None = None, prefix: str = suppress.PREFIX, complete: bool = True) -> Report:
    """Plans all enabled rules over ``files``.

    ``inventory`` (path, kind) lists what links may lead to besides the files
    and their folders. ``complete`` says that ``files`` is the whole workspace.
    Settings of languages and lexicons are those of the root configuration.
    """
    configs = configs or {"": config.settled({})}
    root = configs[""]
    spark = files.sparkSession
    plan = policies(files, configs)
    chosen = plan.where("included and not excluded")
    docs = files.select(F.col("filename").alias("doc"), "text").join(chosen.select("doc"), "doc", "left_semi")
    # Every rule reads the shredded rows, so they are written once.
    shredded = written(markdown.shred(docs, "doc"), "shredded")
    mapped = chosen.select("doc", F.col("mapped").alias("kind"))
    told = shredded.select("doc", "language", "front").join(chosen, "doc")
    known = told.withColumn("kind", structure.resolved_kind(F.col("front"), F.col("mapped")))
    canonical = F.coalesce(F.col("front.canonical") & (F.size("front.errors") == 0), F.lit(False))
    known = written(known.withColumn("canonical", canonical), "policies")
    enabled = written(enabled_rules(known, known), "enabled")
    codes = {r.code for r in enabled.select("code").distinct().collect()}  # at most one row per rule
    empty = spark.createDataFrame([], f"doc {shredded.schema['doc'].dataType.simpleString()}, code string")
    found: list[DataFrame] = []
    undecided: list[DataFrame] = [empty]
    languages, extra = root["lint"]["languages"], config.extra_words(root)
    if codes & {"KND001", "KND002"}:
        found.append(structure.kinds(shredded, mapped))
    resolved = None
    if codes & _NEED_LINKS:
        resolved = written(_resolved(shredded, known, files, inventory), "links")
    if codes & _LEXICAL:
        rooted = resolved.withColumn("root", (F.col("state") == "local") & (F.get("places", F.lit(0))["path"] == "") & ~F.contains("destination", F.lit(":")) & ~F.col("destination").rlike("[#?{}$]") & (F.col("destination") != "")) if resolved is not None else None
        rows, left = lexical.run(markdown.table(shredded, "sentences"), markdown.table(shredded, "blocks"), rooted, codes & _LEXICAL, languages, extra)
        found.append(rows)
        undecided += [left] if left is not None else []
    if codes & _STRUCTURE:
        rows, left = structure.preambles(shredded, codes & _STRUCTURE, languages)
        flow = F.array(F.struct(F.col("doc").alias("filename"), F.col("flow_start").alias("start"), F.col("flow_stop").alias("stop")))
        found.append(rows.select("doc", "code", "start", "stop", F.when(F.col("flow_start").isNotNull(), flow).alias("related")))
        undecided.append(left)
    if codes & _LINKS:
        catalogs = [normal for f, s in configs.items() for normal in ("/".join(x for x in (f, d.strip("/").removeprefix("./")) if x) for d in s["lint"]["ptr"]["catalog-dirs"])]
        rows = across.link_rules(resolved, spark.createDataFrame([(c,) for c in catalogs], "path string"))
        found.append(rows.select("doc", "code", "start", "stop", F.concat("destination", F.lit(" leads to no place that it may.")).alias("message")))
        undecided.append(across.undecided_links(resolved))
    if codes & _SHARED:
        rows, left = _shared(shredded, known, codes, resolved, docs)
        found.append(rows)
        undecided += left
        if not complete:
            undecided.append(enabled.where(F.col("code").isin(*_SHARED)))
    diagnostics = found[0]
    for rows in found[1:]:
        diagnostics = diagnostics.unionByName(rows, allowMissingColumns=True)
    for name, kind in (("message", "string"), ("related", f"array<struct<filename:{shredded.schema['doc'].dataType.simpleString()},start:bigint,stop:bigint>>")):
        if name not in diagnostics.columns:
            diagnostics = diagnostics.withColumn(name, F.lit(None).cast(kind))
    incomplete = undecided[0]
    for rows in undecided[1:]:
        incomplete = incomplete.unionByName(rows)
    # Suppression reads these several times.
    diagnostics = written(diagnostics.join(enabled, ["doc", "code"], "left_semi"), "diagnostics")
    incomplete = written(incomplete.join(enabled, ["doc", "code"], "left_semi").distinct(), "incomplete")
    records = suppress.declarations(markdown.table(shredded, "comments"), registry.CODES, prefix)
    records = written(records.join(known.where("kind is null or kind <> 'generated'").select("doc"), "doc", "left_semi"), "records")
    done = suppress.suppressed(diagnostics, records, enabled, incomplete)
    planned = edits.stale_edits(records, done.stale, docs, prefix)
    kept = [shredded, known, enabled, diagnostics, incomplete, records, done.winners, done.unused, *([resolved] if resolved is not None else [])]
    return Report(done.diagnostics, incomplete, done, planned, known, enabled, shredded, resolved, kept)


def _resolved(shredded: DataFrame, known: DataFrame, files: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """Links with their state, places and status."""
    rows = markdown.table(shredded, "links").withColumn("link", F.xxhash64("doc", "idx")).withColumn("source", F.col("doc"))
    rows = links.candidates(rows.join(known.select("doc", "site_root", "site_public", "site_base"), "doc"))
    listed = files.select(F.col("filename").alias("path"), F.lit("file").alias("kind"))
    if inventory is not None:
        listed = listed.unionByName(inventory.select("path", "kind")).groupBy("path").agg(F.min_by("kind", F.when(F.col("kind") == "unknown", 0).when(F.col("kind") == "file", 1).otherwise(2)).alias("kind"))
    parts = F.split("path", "/")
    folders = listed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))).alias("path")).where("path <> ''").distinct()
    every = listed.unionByName(folders.join(listed.select("path"), "path", "left_anti").withColumn("kind", F.lit("directory")))
    names = shredded.select(F.col("doc").alias("filename"), F.explode_outer(F.transform("anchors", lambda a: a["name"])).alias("anchor"))
    names = names.unionByName(shredded.select(F.col("doc").alias("filename"), F.lit(None).cast("string").alias("anchor")))
    return links.resolutions(links.placed(rows, every), names)


def _shared(shredded: DataFrame, known: DataFrame, codes: set[str], resolved: DataFrame | None, docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Diagnostics of repeated content and its owners; all families count where OWN002 runs."""
    every = "OWN002" in codes
    parts: list[tuple[str, DataFrame, DataFrame]] = []
    left: list[DataFrame] = []
    if codes & {"DUP001", "OWN001"} or every:
        units = across.definition_units(shredded)
        if "DUP001" in codes or every:
            parts.append(("DUP001", units, across.similar_units(units, known, "min_jaccard", "names", "min_identifiers")))
        if "OWN001" in codes or every:
            plans = known.where("kind = 'plan'").select("doc").join(units.select("doc", "unit"), "doc").select("unit")
            met = across.similar_units(units, known, "min_jaccard", "heads", "min_identifiers")
            one = met.join(plans.select(F.col("unit").alias("a")), "a", "left_semi").unionByName(met.join(plans.select(F.col("unit").alias("b")), "b", "left_semi").select("a", "b"))
            parts.append(("OWN001", units, one.distinct()))
    if "DUP002" in codes or every:
        units = across.section_units(shredded)
        spots = shredded.select(F.col("doc").alias("filename"), F.inline("anchors")).withColumnRenamed("name", "anchor")
        met, undecided = across.restatements(units, resolved, spots, known, docs)
        parts.append(("DUP002", units, met))
        left = [undecided.select("doc", F.lit(c).alias("code")) for c in ("DUP002", "OWN002")]
    if "DUP003" in codes or every:
        units = across.paragraph_units(shredded, known)
        parts.append(("DUP003", units, across.similar_units(units, known, "min_paragraph_similarity")))
    edges, units = None, None
    for family, u, e in parts:
        e, u = e.withColumn("family", F.lit(family)), u.select("unit", "doc", "start", "stop")
        edges = e if edges is None else edges.unionByName(e)
        units = u if units is None else units.unionByName(u)
    return across.owned(edges, units.distinct(), known), left
