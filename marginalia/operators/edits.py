"""Edits: planning the removal of stale suppressions, and splicing edits into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bytes(text: Column, start: Column, n: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, n), "UTF-8")


def stale_edits(records: DataFrame, stale: DataFrame, docs: DataFrame, prefix: str) -> DataFrame:
    """Edits (doc, record, start, stop, replacement) that take stale codes out of suppression comments.

    ``records`` has (record, doc, start, stop, codes), ``stale`` (record, code),
    ``docs`` (doc, text). Where all codes go, so does the comment, and with it
    its line if it stands alone and does not part two lines of content.
    """
    gone = stale.groupBy("record").agg(F.collect_set("code").alias("gone"))
    rows = records.join(gone, "record").join(docs.select("doc", F.col("text").alias("_text")), "doc")
    raw = F.encode("_text", "UTF-8")
    comment = F.decode(F.substring(raw, F.col("start") + 1, F.col("stop") - F.col("start")), "UTF-8")
    pattern = rf"^(?s)<!--\s*\Q{prefix}\E\s*(?:allow-file|allow)\s+"
    lead = F.regexp_extract(comment, pattern, 0)
    listed = F.regexp_replace(F.regexp_extract(comment, pattern + r"(.*?)\s*--.*$", 1), r"\s+$", "")
    kept = F.array_except("codes", "gone")
    rows = rows.withColumns({"kept": kept, "lead": lead, "listed": listed})
    before = F.decode(F.substring(raw, F.lit(1), F.col("start")), "UTF-8")
    after = F.decode(F.substring(raw, F.col("stop") + 1, F.octet_length("_text")), "UTF-8")
    line_before, line_after = F.regexp_extract(before, r"([^\n]*)$", 1), F.regexp_extract(after, r"^([^\n]*\n?)", 1)
    above = F.regexp_extract(F.regexp_replace(F.substring(before, F.lit(1), F.length(before) - F.length(line_before)), r"[\r\n]+$", ""), r"([^\n]*)$", 1)
    below = F.regexp_extract(F.substring(after, F.length(line_after) + 1, F.length(after)), r"^([^\n]*)", 1)
    parts = (F.trim(above) != "") & (F.trim(below) != "")
    alone = (F.trim(line_before) == "") & (F.trim(F.regexp_replace(line_after, r"[\r\n]", "")) == "") & ~parts
    trimmed = F.struct(
        (F.col("start") + F.octet_length("lead")).alias("start"), (F.col("start") + F.octet_length("lead") + F.octet_length("listed")).alias("stop"),
        F.array_join("kept", ", ").alias("replacement"),
    )
    whole = F.struct(
        F.when(alone, F.col("start") - F.octet_length(line_before)).otherwise(F.col("start")).alias("start"),
        F.when(alone, F.col("stop") + F.octet_length(line_after)).otherwise(F.col("stop")).alias("stop"), F.lit("").alias("replacement"),
    )
    edit = F.when(F.size("kept") > 0, trimmed).otherwise(whole)
    same = F.transform(F.split("listed", ","), lambda c: F.trim(c)) == F.col("codes")
    return rows.where((F.col("lead") != "") & same).select("doc", "record", edit.alias("e")).select("doc", "record", "e.*")


def apply_edits(docs: DataFrame, edits: DataFrame, text: str = "text") -> DataFrame:
    """Texts with byte edits (doc, start, stop, replacement) applied; overlapping edits, or two at one place, leave a text alone."""
    order = Window.partitionBy("doc").orderBy("start", "stop")
    chosen = edits.select("doc", "start", "stop", "replacement").distinct()
    follows = (F.lead("start").over(order) < F.col("stop")) | (F.lead("start").over(order) == F.col("start"))
    marked = chosen.withColumn("clash", F.coalesce(follows, F.lit(False)))
    per = marked.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "replacement"))).alias("edits"), F.max("clash").alias("clash"))
    raw = F.encode(text, "UTF-8")

    def step(done: Column, e: Column) -> Column:
        kept = F.substring(raw, done["at"] + 1, (e["start"] - done["at"]).cast("int"))
        return F.struct(e["stop"].cast("int").alias("at"), F.concat(done["out"], kept, F.encode(e["replacement"], "UTF-8")).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.encode(F.lit(""), "UTF-8").alias("out"))
    spliced = F.aggregate("edits", begin, step, lambda d: F.decode(F.concat(d["out"], F.substring(raw, d["at"] + 1, F.length(raw))), "UTF-8"))
    rows = docs.join(per, "doc", "left")
    return rows.withColumn("fixed", F.when(F.col("clash").isNull() | F.col("clash"), F.col(text)).otherwise(spliced)).drop("edits", "clash")
