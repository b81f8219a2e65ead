"""Suppression comments: declarations, their scopes and states, and what they hide.

A declaration is ``PREFIX allow CODE[, CODE] -- reason`` before a block or in a
paragraph, item or cell, or ``PREFIX allow-file ...`` before all content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

PREFIX = "marginalia:"


@dataclass
class Suppressed:
    diagnostics: DataFrame  # what is left, with SUP001 and SUP002
    records: DataFrame  # (record, doc, start, stop, codes, reason, error, scope_start, scope_stop, scope)
    states: DataFrame  # (record, doc, code, state, hits)
    stale: DataFrame  # (record, code) that SUP002 reports
    winners: DataFrame  # written tables behind these
    unused: DataFrame


def declarations(comments: DataFrame, codes: tuple[str, ...], prefix: str = PREFIX) -> DataFrame:
    """Records of comments (doc, content, start, stop, alone, leading, next_*, inner_*), in source order.

    ``error`` is the first thing wrong with a record, which then has no scope.
    """
    content = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    rows = comments.where(F.startswith(F.regexp_replace("content", r"^\s+", ""), F.lit(prefix)))
    body = F.regexp_replace(F.substring(content, len(prefix) + 1, F.length(content)), r"^\s+|\s+$", "")
    rows = rows.withColumn("_body", body).withColumn("_command", F.regexp_extract("_body", r"^(\S+)\s", 1)).withColumn("_said", F.regexp_extract("_body", r"(?s)^\S+\s+(.*)$", 1))
    parted = F.contains("_said", F.lit("--"))
    listed = F.when(parted, F.substring_index("_said", "--", 1)).otherwise(F.col("_said"))
    reason = F.when(parted, F.regexp_replace(F.regexp_extract("_said", r"(?s)^.*?--(.*)$", 1), r"^\s+|\s+$", "")).otherwise("")
    rows = rows.withColumns({"codes": F.transform(F.split(listed, ","), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), "reason": reason})
    known = F.array(*map(F.lit, codes))
    unknown = F.get(F.filter("codes", lambda c: ~F.array_contains(known, c)), F.lit(0))
    placed = F.when(F.col("_command") == "allow-file", F.col("alone") & F.col("leading")).when(F.col("alone"), F.col("next_start").isNotNull()).otherwise(F.col("inner_start").isNotNull())
    error = (
        F.when(F.col("_command") == "", "expected a command, full rule codes, and a reason")
        .when(~F.col("_command").isin("allow", "allow-file"), F.concat(F.lit("unknown command "), "_command"))
        .when(~parted, "the reason must follow --").when(F.col("content").rlike(r"[\r\n]"), "the declaration must fit on one line")
        .when(F.col("reason") == "", "a reason is required").when(unknown.isNotNull(), F.concat(unknown, F.lit(" is not a known full rule code")))
        .when(F.size(F.array_distinct("codes")) < F.size("codes"), "a rule is listed more than once")
        .when(~placed, F.when(F.col("_command") == "allow-file", "allow-file must come before all content").when(F.col("alone"), "allow must come before a block of content").otherwise("allow must be in a paragraph, item or cell"))
    )
    rows = rows.withColumn("error", error)
    whole = F.col("_command") == "allow-file"
    ends = {n: F.when(F.col("error").isNull() & ~whole, F.when(F.col("alone"), F.col(f"next_{n}")).otherwise(F.col(f"inner_{n}"))).cast("long") for n in ("start", "stop")}
    return rows.select(
        F.xxhash64("doc", "start", "stop").alias("record"), "doc", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
        F.when(F.col("_command") != "", F.col("codes")).otherwise(F.array().cast("array<string>")).alias("codes"), "reason", "error",
        ends["start"].alias("scope_start"), ends["stop"].alias("scope_stop"), F.when(F.col("error").isNull(), F.when(whole, "file").otherwise("block")).alias("scope"),
    )


def _winners(d: DataFrame, usable: DataFrame) -> DataFrame:
    """Rows (id, record): what hides a diagnostic (id, doc, code, start, origin): blocks before files, then the smallest, then the first; never its origin."""
    inside = (F.col("scope") == "file") | ((F.col("start") >= F.col("scope_start")) & (F.col("start") < F.col("scope_stop")))
    met = d.join(usable, ["doc", "code"]).where(inside & ~F.coalesce(F.col("origin") == F.col("record"), F.lit(False)))
    order = F.struct(F.when(F.col("scope") == "file", 1).otherwise(0), F.coalesce(F.col("scope_stop") - F.col("scope_start"), F.lit(1 << 62)), F.col("at"))
    return met.groupBy("id").agg(F.min_by("record", order).alias("record"), F.first("doc").alias("doc"), F.first("code").alias("code"))


def suppressed(diagnostics: DataFrame, records: DataFrame, enabled: DataFrame, incomplete: DataFrame) -> Suppressed:
    """Applies records to diagnostics (doc, code, start, stop, ...) in three strata.

    First ordinary diagnostics and SUP001; then SUP002 for stale codes, which a
    record of another comment may hide; then stale SUP002 declarations, which
    nothing hides. ``enabled`` and ``incomplete`` have (doc, code). Added
    diagnostics have no columns but doc, code, start, stop and message.
    """
    listed = records.where("error is null").select("record", "doc", "scope", "scope_start", "scope_stop", F.col("start").alias("at"), F.explode("codes").alias("code"))
    usable = listed.join(enabled.select("doc", "code"), ["doc", "code"], "left_semi")
    wrong = records.where("error is not null").join(enabled.where("code = 'SUP001'").select("doc"), "doc", "left_semi")
    wrong = wrong.select("doc", F.lit("SUP001").alias("code"), "start", "stop", F.concat(F.lit("Invalid suppression: "), "error").alias("message"))
    every = diagnostics.unionByName(wrong, allowMissingColumns=True)
    every = every.withColumn("id", F.xxhash64(*[c for c in every.columns if c in ("doc", "code", "start", "stop", "message", "related")])).withColumn("origin", F.lit(None).cast("long"))
    first = written(_winners(every, usable), "winners")
    left = every.join(first.select("id"), "id", "left_anti")
    hits = first.groupBy("record", "code").agg(F.count("*").alias("hits"))
    open_codes = incomplete.select("doc", "code").distinct().withColumn("open", F.lit(True))
    told = usable.join(hits, ["record", "code"], "left").join(open_codes, ["doc", "code"], "left")
    checked = enabled.where("code = 'SUP002'").select("doc").join(incomplete.where("code = 'SUP002'").select("doc"), "doc", "left_anti")
    stale = written(told.where("hits is null and open is null").join(checked, "doc", "left_semi").select("record", "doc", "code"), "stale")
    spans = records.select("record", "doc", "start", "stop")
    report = lambda rows: rows.join(spans, ["record", "doc"]).select(
        "doc", F.lit("SUP002").alias("code"), "start", "stop", F.concat(F.lit("Suppression for "), F.col("code"), F.lit(" did not suppress any diagnostic.")).alias("message"), F.col("record").alias("origin"), F.col("code").alias("stale"),
    )
    unused = report(stale.where("code <> 'SUP002'")).withColumn("id", F.xxhash64("doc", "start", "stop", "stale"))
    second = _winners(unused, usable.where("code = 'SUP002'"))
    shown = unused.join(second.select("id"), "id", "left_anti")
    more = second.groupBy("record").agg(F.count("*").alias("more")).withColumn("code", F.lit("SUP002"))
    last = stale.where("code = 'SUP002'").join(more, ["record", "code"], "left_anti")
    left = left.drop("id", "origin").unionByName(shown.select("doc", "code", "start", "stop", "message"), allowMissingColumns=True)
    left = left.unionByName(report(last).select("doc", "code", "start", "stop", "message"), allowMissingColumns=True)
    counted = told.join(more, ["record", "code"], "left").withColumn("n", F.coalesce("hits", F.lit(0)) + F.coalesce("more", F.lit(0)))
    live = counted.select("record", "doc", "code", F.when(F.col("open"), "incomplete").when(F.col("n") > 0, "active").otherwise("stale").alias("state"), F.col("n").alias("hits"))
    off = listed.join(enabled.select("doc", "code"), ["doc", "code"], "left_anti").select("record", "doc", "code", F.lit("rule_disabled").alias("state"), F.lit(0).cast("long").alias("hits"))
    bad = records.where("error is not null").select("record", "doc", F.explode("codes").alias("code"), F.lit("invalid").alias("state"), F.lit(0).cast("long").alias("hits"))
    gone = shown.select(F.col("origin").alias("record"), F.col("stale").alias("code")).unionByName(last.select("record", "code"))
    return Suppressed(left, records, live.unionByName(off).unionByName(bad.distinct()), gone, first, stale)


def inspected(records: DataFrame, enabled: DataFrame) -> DataFrame:
    """States (record, doc, code, state) of declarations before any rule has run."""
    rows = records.select("record", "doc", "error", F.explode("codes").alias("code")).distinct()
    rows = rows.join(enabled.select("doc", "code", F.lit(True).alias("on")), ["doc", "code"], "left")
    state = F.when(F.col("error").isNotNull(), "invalid").when(F.col("on").isNull(), "rule_disabled").otherwise("not_evaluated")
    return rows.select("record", "doc", "code", state.alias("state"))
