"""Policy: globs, kinds, rule selection and suppression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression; ``*`` and ``?`` stay within a path component, ``**`` crosses them."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_pattern(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def last_match(value: Column, mapping: list[tuple[str, str]]) -> Column:
    """The value of the last pattern (regular expression) that matches, or null."""
    out = F.lit(None).cast("string")
    for pattern, kind in mapping:
        out = F.when(value.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def selected_rules(files: DataFrame, rules: DataFrame, selectors: DataFrame) -> DataFrame:
    """Rules (filename, code) selected for each file.

    ``files`` has (filename) and may have (preview: boolean); ``rules`` (code,
    family, stable); ``selectors`` (filename, selector, action: select, ignore
    or per_file). A code is more specific than a family, a family than ALL; on
    a tie, ignore wins. Rules that are not stable need the preview, whatever
    selects them, and any selector under per_file takes a rule out.
    """
    preview = F.col("preview") if "preview" in files.columns else F.lit(False)
    pairs = selectors.join(files.select("filename", F.coalesce(preview, F.lit(False)).alias("preview")), "filename")
    family = F.substring("code", 1, 3) if "family" not in rules.columns else F.col("family")
    # A selector names rules by a few keys, so that it meets them by equality.
    keys = F.explode(F.array(F.struct(F.col("code").alias("selector"), F.lit(2).alias("s")), F.struct(family.alias("selector"), F.lit(1).alias("s")), F.struct(F.lit("ALL").alias("selector"), F.lit(0).alias("s"))))
    scored = pairs.join(rules.select("code", "stable", keys.alias("k")).select("code", "stable", "k.*"), "selector")
    best = scored.groupBy("filename", "code", "stable", "preview").agg(
        F.max(F.when(F.col("action") == "select", F.col("s"))).alias("on"), F.max(F.when(F.col("action") == "ignore", F.col("s"))).alias("off"),
        F.max(F.col("action") == "per_file").alias("out"),
    )
    on = (F.col("on") > F.coalesce("off", F.lit(-1))) & (F.col("stable") | F.col("preview")) & ~F.col("out")
    return best.where(on).select("filename", "code")


def suppression_winner(points: DataFrame, records: DataFrame) -> DataFrame:
    """For each diagnostic (doc, code, at, id), the record that suppresses it.

    ``records`` has (doc, code, start, stop, scope, record): block scope (0)
    wins over file scope (1), then the shortest, then the first.
    """
    hits = points.join(records, ["doc", "code"]).where("at >= start and at < stop")
    best = F.struct("scope", (F.col("stop") - F.col("start")).alias("length"), "start", "record")
    return hits.groupBy("doc", "code", "id").agg(F.min(best).alias("b")).select("doc", "code", "id", F.col("b.record").alias("record"))


def record_states(records: DataFrame, winners: DataFrame, enabled: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Suppression records (record, doc, code, valid) with state and hits."""
    hits = winners.groupBy("record", "code").agg(F.count("*").alias("hits"))
    rows = records.join(hits, ["record", "code"], "left")
    rows = rows.join(enabled.select("doc", "code", F.lit(True).alias("on")), ["doc", "code"], "left")
    rows = rows.join(incomplete.select("doc", "code", F.lit(True).alias("open")), ["doc", "code"], "left")
    state = (
        F.when(~F.col("valid"), "invalid").when(F.col("on").isNull(), "rule_disabled").when(F.col("hits") > 0, "active")
        .when(F.col("open").isNotNull(), "incomplete").otherwise("stale")
    )
    return rows.select("record", "doc", "code", state.alias("state"), F.coalesce("hits", F.lit(0)).alias("hits"))


def directives(comments: DataFrame, comment: str = "comment") -> DataFrame:
    """Comments that allow codes: scope, codes, reason and the first thing wrong with them."""
    c = F.trim(comment)
    scope = F.regexp_extract(c, r"^(allow-file|allow)\b", 1)
    body = F.regexp_extract(c, r"^(?:allow-file|allow)\s+(.*?)(?:\s+--\s*(.*))?$", 1)
    reason = F.regexp_extract(c, r"\s--\s*(.*)$", 1)
    codes = F.transform(F.split(body, ","), lambda x: F.trim(x))
    wrong = (
        F.when(body == "", "missing code").when(F.exists(codes, lambda x: ~x.rlike(r"^[A-Z]{3}[0-9]{3}$")), "malformed code")
        .when(F.size(F.array_distinct(codes)) < F.size(codes), "repeated code").when(reason == "", "missing reason")
    )
    return comments.where(scope != "").withColumns({"scope": scope, "codes": codes, "reason": reason, "error": wrong})


def stratified_sample(rows: DataFrame, strata: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each stratum."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)
