"""Workspace files: scan, filters, overlays, decoding and content-addressed parsing."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import glob_pattern

#: Folders that are never part of a workspace.
SKIPPED = (".git", ".cache")


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, git_ignore: bool = True) -> DataFrame:
    """Rows (filename, content: binary, size) of Markdown files below ``root``.

    Filters act on the path before a file's content is read. What .gitignore
    files leave out is left out, unless ``git_ignore`` is off.
    """
    rows = _files(spark, root)
    if git_ignore:
        patterns = [p for folder, text in ignore_files(spark, root) for p in ignore_patterns(folder, text)]
        rows = rows.where(~ignored(F.col("filename"), patterns))
    return filtered(rows, include, exclude).where(markdown(F.col("filename")))


def _files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    name = F.regexp_replace("path", rf"^.*?\Q{base}\E/", "")
    return files.select(name.alias("filename"), "content", F.col("length").alias("size"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, kind) of all files below ``root`` and the folders that hold them."""
    files = _files(spark, root).select(F.col("filename").alias("path"))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))
    folders = files.select(F.explode(up).alias("path")).where("path <> ''").distinct()
    return files.withColumn("kind", F.lit("file")).unionByName(folders.withColumn("kind", F.lit("directory")))


def ignore_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """The .gitignore files below ``root`` as (folder, text), outer folders first.

    Spark's readers pass over hidden files, so the driver walks the folders'
    names; the files themselves are configuration, of which there are few.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(top).toUri().getPath().rstrip("/")
    out, waiting = [], [top]
    while waiting:
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(waiting.pop())):
            path = status.getPath().toUri().getPath()
            name = path.rsplit("/", 1)[-1]
            if status.isDirectory() and name not in SKIPPED:
                waiting.append(path)
            elif name == ".gitignore":
                stream = fs.open(status.getPath())
                out.append((path[len(top) + 1 :].rpartition("/")[0], jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
    return sorted(out, key=lambda x: (x[0].count("/") + bool(x[0]), x[0]))


def ignore_patterns(folder: str, text: str) -> list[tuple[str, bool]]:
    """The patterns of a .gitignore file in ``folder`` as (regular expression of paths, whether they are kept)."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        kept, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        only_folders, line = line.endswith("/"), line.rstrip("/")
        anywhere, line = "/" not in line, line.removeprefix("/")
        body = glob_pattern(line)[1:-1]
        lead = "^" + (re.escape(folder) + "/" if folder else "") + ("(?:.*/)?" if anywhere else "")
        out.append((lead + body + ("/" if only_folders else "(?:/|$)"), kept))
    return out


def ignored(path: F.Column, patterns: list[tuple[str, bool]]) -> F.Column:
    """Whether the last pattern that matches a path leaves it out."""
    out = F.lit(False)
    for pattern, kept in patterns:
        out = F.when(path.rlike(pattern), F.lit(not kept)).otherwise(out)
    return out


def markdown(filename) -> F.Column:
    return F.lower(filename).rlike(r"\.(?:md|markdown)$")


def filtered(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files that an include glob matches (all, without any) and no exclude glob does."""
    keep = ~F.col("filename").rlike("|".join(rf"(?:^|/)\Q{d}\E/" for d in SKIPPED))
    if include:
        keep &= F.col("filename").rlike("|".join(map(glob_pattern, include)))
    if exclude:
        keep &= ~F.col("filename").rlike("|".join(map(glob_pattern, exclude)))
    return files.where(keep)


def requested(files: DataFrame, paths: list[str]) -> DataFrame:
    """Files that are one of the paths or below one, by whole path components."""
    if not paths or "" in paths or "." in paths:
        return files
    keep = F.lit(False)
    for p in (x.rstrip("/") for x in paths):
        keep |= (F.col("filename") == p) | F.startswith("filename", F.lit(p + "/"))
    return files.where(keep)


def overlaid(files: DataFrame, overlay: DataFrame) -> DataFrame:
    """Files with those of ``overlay`` replaced or added."""
    return files.join(overlay.select("filename"), "filename", "left_anti").unionByName(overlay)


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (filename, text), and errors (filename, message) of files that are not UTF-8."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.withColumn("text", text)
    bad = rows.where("text is null").select("filename", F.lit("stream did not contain valid UTF-8").alias("message"))
    return rows.where("text is not null").select("filename", "text"), bad


def by_content(docs: DataFrame, parse: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """Parses each distinct text once and joins the results back.

    ``parse`` takes (content, text) and returns (content, ...).
    """
    keyed = docs.withColumn("content", F.sha2(text, 256))
    once = keyed.groupBy("content").agg(F.first(text).alias("text"))
    return keyed.join(parse(once), "content")


def skipped(paths: DataFrame, files: DataFrame, known: DataFrame, patterns: list[tuple[str, bool]] | None = None) -> DataFrame:
    """Requested paths (path) that select no file, and why.

    ``files`` has the (filename) that are checked, ``known`` (filename, included,
    excluded) what configuration says of all files.
    """
    gone = paths.join(_below(files).select("path").distinct(), "path", "left_anti")
    held = gone.join(_below(known), "path", "left").groupBy("path")
    held = held.agg(F.count("filename").alias("n"), F.max(F.col("filename") == F.col("path")).alias("file"), F.max(~F.col("included")).alias("out"), F.max("excluded").alias("cut"))
    file = F.coalesce("file", F.lit(False)) | F.col("path").rlike(r"\.[A-Za-z0-9]+$")
    why = (
        F.when(file & ~markdown(F.col("path")), "it is not a .md or .markdown file")
        .when(file & F.col("cut"), "exclude matches it").when(file & F.col("out"), "include does not match it")
        .when(ignored(F.col("path"), patterns or []) | ignored(F.concat("path", F.lit("/")), patterns or []), ".gitignore ignores it")
        .when(F.col("n") > 0, F.concat(F.lit("configuration excludes its "), "n", F.lit(" Markdown files"))).when(file, "it was not found").otherwise("it contains no Markdown files")
    )
    return held.select("path", why.alias("reason"))


def _below(files: DataFrame) -> DataFrame:
    """Files once for each path that they are or lie below."""
    parts = F.split("filename", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.withColumn("path", F.explode(F.concat(F.array(F.lit(".")), above)))


def inventory_errors(entries: DataFrame) -> DataFrame:
    """Rows of an inventory (path, kind) that break it: repeated paths, and files with entries below them."""
    twice = entries.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("repeated path").alias("error"))
    parents = entries.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), i - 1), "/"))).alias("path")).where("path <> ''").distinct()
    nested = entries.where("kind = 'file'").join(parents, "path", "left_semi").select("path", F.lit("file with entries below").alias("error"))
    return twice.unionByName(nested)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Markdown files (path, blob) of two revisions that were added, modified or deleted: rows (path, status, before, after)."""
    old, new = before.select("path", F.col("blob").alias("before")), after.select("path", F.col("blob").alias("after"))
    rows = old.join(new, "path", "full_outer").where(markdown(F.col("path")) & ~F.col("before").eqNullSafe(F.col("after")))
    return rows.select("path", F.when(F.col("before").isNull(), "A").when(F.col("after").isNull(), "D").otherwise("M").alias("status"), "before", "after")
