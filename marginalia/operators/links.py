"""Links: extraction from HTML, resolution against files, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_RAW = r"(?is)<(script|style|textarea|title)\b[^>]*>.*?</\1\s*>"


def without_raw_text(html: Column) -> Column:
    """HTML without the elements whose content is not markup, and without comments."""
    return F.regexp_replace(F.regexp_replace(html, _RAW, ""), r"(?s)<!--.*?-->", "")


def html_links(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pos, href)."""
    found = F.regexp_extract_all(without_raw_text(F.col("html")), F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def html_comments(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pos, comment), raw-text elements left out."""
    stripped = F.regexp_replace("html", _RAW, "")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(stripped, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))).alias("pos", "comment"))


def anchors(pages: DataFrame) -> DataFrame:
    """Rows (page_id, anchor): id and name attributes, and slugs of headings."""
    clean = without_raw_text(F.col("html"))
    named = F.regexp_extract_all(clean, F.lit(r'\s(?:id|name)="([^"]+)"'), F.lit(1))
    heads = F.transform(F.regexp_extract_all(clean, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda h: T.slug(F.trim(h)))
    return pages.select("page_id", F.explode(F.array_distinct(F.concat(named, heads))).alias("anchor")).where("anchor <> ''")


def _under(path: Column, folder: Column) -> Column:
    return (folder == "") & ~F.startswith(path, F.lit("..")) | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def page_sources(route: Column, directory: Column) -> Column:
    """Paths of Markdown sources that a site renders at a route, best first; a route that ends in / names a folder first."""
    at = lambda *suffixes: F.array(*[F.concat(route, F.lit(x)) for x in suffixes])
    folder = F.when(route == "", "").otherwise(F.concat(route, F.lit("/")))
    inside = F.array(*[F.concat(folder, F.lit(x)) for x in ("index.md", "index.mdx", "README.md", "README.mdx")])
    pages = at(".md", ".mdx")
    stem = F.regexp_replace(route, r"\.html$", "")
    index = F.when(stem.rlike(r"(?:^|/)index$"), F.array(F.concat(stem, F.lit(".md")), F.concat(F.regexp_replace(stem, "index$", ""), F.lit("README.md"))))
    html = F.coalesce(index, F.array(F.concat(stem, F.lit(".md"))))
    return F.when(route.rlike(r"\.html$"), html).when(directory, F.concat(inside, pages)).otherwise(F.concat(pages, inside))


def candidates(links: DataFrame) -> DataFrame:
    """Links (source, destination, site_root, site_public, site_base) with what they say: state, anchor and places.

    ``state`` is external, template, unknown (an escape that cannot be decoded),
    outside, or local; local ones have ``places``, candidates (rank, path,
    form) in order: the path as written, then, in a site, the files and page
    sources of its route. Without a site the site columns are null.
    """
    dest = F.col("destination")
    raw = F.regexp_extract(dest, r"^([^?#]*)", 1)
    rows = links.withColumn("_path", F.replace(T.percent_decoded(raw), F.lit("\\"), F.lit("/")))
    path = F.col("_path")
    folder = F.regexp_extract("source", r"^(.*/)", 1)
    written = F.when(path == "", F.col("source")).when(F.startswith(path, F.lit("/")), F.regexp_replace(path, "^/+", "")).otherwise(F.concat(folder, path))
    fragment = F.when(F.contains(dest, F.lit("#")), F.regexp_extract(dest, r"^[^#]*#(.*)$", 1))
    rows = rows.withColumns({"_written": T.normal_path(written), "anchor": T.percent_decoded(fragment)})
    abroad = F.startswith(dest, F.lit("//")) | T.has_scheme(dest) | path.rlike(r"^//") | T.has_scheme(path)
    state = (
        F.when(abroad, "external").when(path.isNull(), "unknown").when(T.is_template(path), "template")
        .when(F.col("_written").rlike(r"^\.\.(?:/|$)"), "outside").otherwise("local")
    )
    # Routes of a site; a link that begins with / counts from its base.
    base = F.concat(F.regexp_replace(F.coalesce("site_base", F.lit("/")), "/+$", ""), F.lit("/"))
    rooted = F.startswith(path, F.lit("/"))
    rest = F.when(rooted & (path == F.regexp_replace(base, "/+$", "")), "").when(rooted & F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path)))
    root, public = F.regexp_replace("site_root", r"^\.$", ""), F.regexp_replace("site_public", r"^\.$", "")
    slashed = F.endswith(path, F.lit("/"))
    page = T.normal_path(F.concat_ws("/", root, rest))
    as_form = lambda paths, form: F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(form).alias("form")))
    none = F.array().cast("array<struct<path:string,form:string>>")
    routed = F.when(~rooted, as_form(page_sources(F.col("_written"), slashed), "page")).when(
        rest.isNotNull(), F.concat(as_form(F.array(page), "route"), as_form(page_sources(page, slashed), "page"))
    )
    routed = F.filter(F.coalesce(routed, none), lambda c: _under(c["path"], root))
    served = T.normal_path(F.concat_ws("/", public, rest))
    shown = F.when(public.isNotNull() & rest.isNotNull() & (rest != "") & _under(served, public), as_form(F.array(served), "route"))
    more = F.when(F.col("site_root").isNotNull() & (path != ""), F.concat(routed, F.coalesce(shown, none)))
    places = F.concat(as_form(F.array(F.col("_written")), "written"), F.coalesce(more, none))
    return rows.withColumns({"state": state, "places": F.when(state == "local", places)}).drop("_path", "_written")


def placed(links: DataFrame, inventory: DataFrame) -> DataFrame:
    """Where links (link, ..., state, places, anchor) lead, once as files that exist and once as pages.

    ``inventory`` has (path, kind: file, directory or unknown); what lies below
    an unknown entry is unknown. Of a link's candidates the first that exists
    wins; as pages, a folder that is only a route comes after all files. A page
    route in lower case reaches a source with capitals; any other difference in
    case is a mismatch, which counts only if nothing exists. Adds ``existing``
    and ``page``, structs (status, path, actual).
    """
    each = links.where("state = 'local'").select("link", F.posexplode("places").alias("rank", "place")).select("link", "rank", "place.*")
    known = inventory.select(F.col("path").alias("_path"), "kind")
    loose = inventory.groupBy(F.lower("path").alias("_lower")).agg(F.min("path").alias("actual"))
    each = each.join(known, F.col("path") == F.col("_path"), "left").join(loose, F.lower("path") == F.col("_lower"), "left")
    parts = F.split("path", "/")
    above = each.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_up"))
    hidden = above.join(inventory.where("kind = 'unknown'").select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct().withColumn("hidden", F.lit(True))
    each = each.join(hidden, "path", "left")
    same = F.forall(F.zip_with(F.split("path", "/"), F.split("actual", "/"), lambda w, a: (w == a) | (w == F.lower(a))), lambda x: x)
    suffix = lambda c: F.regexp_extract(c, r"(\.[^./]*)$", 1)
    lowered = (F.col("form") == "page") & F.col("actual").isNotNull() & same & (suffix("path") == suffix("actual"))
    kind = F.when(F.col("path") == "", F.coalesce("kind", F.lit("directory"))).otherwise(F.col("kind"))
    status = (
        F.when(F.coalesce("hidden", F.lit(False)), "unknown").when(kind.isNotNull(), kind).when(lowered, "file")
        .when(F.col("actual").isNotNull(), "case_mismatch").otherwise("missing")
    )
    each = each.withColumn("status", status).withColumn("path", F.when(kind.isNull() & lowered, F.col("actual")).otherwise(F.col("path")))
    late = F.when(F.col("status") == "missing", 3).when(F.col("status") == "case_mismatch", 2)
    told = F.struct("status", "path", "actual")
    best = each.groupBy("link").agg(
        F.min_by(told, F.struct(F.coalesce(late, F.lit(0)), "rank")).alias("existing"),
        F.min_by(told, F.struct(F.coalesce(late, F.when((F.col("status") == "directory") & (F.col("form") != "written"), 1).otherwise(0)), "rank")).alias("page"),
    )
    return links.join(best, "link", "left")


def resolutions(placed_links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds ``status`` and ``target``: where a link leads as a page, and whether its anchor is there.

    ``anchors`` has (filename, anchor) and a row (filename, null) for each
    document: of files that are no documents, anchors are unknown.
    """
    target, state, status = F.col("page.path"), F.col("state"), F.col("page.status")
    names = anchors.where("anchor is not null").select(F.col("filename").alias("_file"), F.col("anchor").alias("_name")).distinct()
    docs = anchors.select(F.col("filename").alias("_doc")).distinct()
    rows = placed_links.withColumn("target", F.when(state == "local", target))
    rows = rows.join(docs, F.col("target") == F.col("_doc"), "left").join(names, (F.col("target") == F.col("_file")) & (F.col("anchor") == F.col("_name")), "left")
    asked = F.contains("destination", F.lit("#"))
    empty = ~asked | (F.col("anchor") == "")
    told = (
        F.when(state != "local", state).when(T.is_template(F.coalesce(T.percent_decoded(F.col("destination")), F.lit(""))), "template")
        .when(asked & F.col("anchor").isNull(), "unknown").when(status.isin("missing", "case_mismatch"), "missing").when(status != "file", status)
        .when(empty, "file").when(F.col("_doc").isNull(), "unknown").when(F.col("_name").isNotNull(), "anchor_found").otherwise("anchor_missing")
    )
    return rows.withColumn("status", told).drop("_file", "_name", "_doc")


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (source, destination) with target, anchor and status.

    A written path is tried first, then the same path in another case. A
    destination with a scheme is external; a template or an undecodable path
    is not resolved.
    """
    path = F.regexp_extract("destination", "^([^#]*)", 1)
    anchor = F.when(F.contains("destination", F.lit("#")), T.percent_decoded(F.regexp_extract("destination", "^[^#]*#(.*)$", 1)))
    folder = F.regexp_extract("source", r"^(.*/)", 1)
    decoded = T.percent_decoded(F.regexp_replace(path, r"\?.*$", ""))
    absolute = F.startswith(decoded, F.lit("/"))
    target = F.when(path == "", F.col("source")).otherwise(T.normal_path(F.when(absolute, decoded).otherwise(F.concat(folder, decoded))))
    rows = links.withColumns({"target": target, "anchor": anchor, "external": T.has_scheme(F.col("destination")) | F.startswith("destination", F.lit("//")), "template": T.is_template(F.coalesce(decoded, F.lit("")))})
    exact = files.select(F.col("filename").alias("_exact")).distinct()
    # One file of each spelling: the first by name.
    loose = files.groupBy(F.lower("filename").alias("_lower")).agg(F.min("filename").alias("_loose"))
    rows = rows.join(exact, F.col("target") == F.col("_exact"), "left").join(loose, F.lower("target") == F.col("_lower"), "left")
    outside = F.startswith("target", F.lit(".."))
    status = (
        F.when(F.col("external"), "external").when(F.col("template"), "template").when(F.col("target").isNull(), "invalid")
        .when(outside, "outside").when(F.col("_exact").isNotNull(), "found").when(F.col("_loose").isNotNull(), "case_mismatch").otherwise("missing")
    )
    return rows.select(*links.columns, F.coalesce("_exact", "_loose", "target").alias("target"), "anchor", status.alias("status"))


def first_candidate(candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    """For each link, the first candidate path (link, rank, path) that is a file.

    A directory on the way is only reported if no later candidate is a file.
    """
    kinds = candidates.join(inventory.select("path", "kind"), "path", "left")
    order = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "directory", 1).otherwise(2)
    best = kinds.groupBy("link").agg(F.min(F.struct(order.alias("o"), "rank", "path")).alias("b"))
    status = F.element_at(F.array(F.lit("found"), F.lit("directory"), F.lit("missing")), F.col("b.o") + 1)
    return best.select("link", F.col("b.path").alias("path"), status.alias("status"))


def missing_anchors(links: DataFrame, known: DataFrame) -> DataFrame:
    """Found links whose anchor the target does not have; ``known`` has (filename, anchor)."""
    asked = links.where((F.col("status") == "found") & (F.col("anchor") != ""))
    return asked.join(known.select(F.col("filename").alias("target"), "anchor"), ["target", "anchor"], "left_anti")


def directory_pointers(links: DataFrame, inventory: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Links to a directory that is no declared catalogue."""
    folders = inventory.where("kind = 'directory'").select(F.col("path").alias("target"))
    return links.join(folders, "target", "left_semi").join(catalogs.select(F.col("path").alias("target")), "target", "left_anti")
