"""Reports: canonical order and renderings of diagnostics.

Diagnostics have (filename, row, col, end_row, end_col, code, message,
related: array of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("filename", "row", "col", "code", "end_row", "end_col", "message")


def canonical(d: DataFrame) -> DataFrame:
    """Diagnostics in canonical order, ties broken by every field."""
    rest = [F.to_json(F.array_sort("related"))] if "related" in d.columns else []
    return d.orderBy(*ORDER, *rest)


def located(d: DataFrame, shredded: DataFrame, docs: DataFrame) -> DataFrame:
    """Diagnostics (doc, start, stop, ...) with filename, row, col, end_row and end_col: lines from 1, columns in code points.

    ``shredded`` has (doc, lines: first bytes), ``docs`` (doc, text). Both bytes
    of a line end of two belong to the line's last column.
    """
    rows = d.join(shredded.select("doc", "lines"), "doc").join(docs.select("doc", F.encode("text", "UTF-8").alias("_raw")), "doc")

    def place(byte: Column) -> Column:
        row = F.size(F.filter("lines", lambda x: x <= byte))
        first = F.get("lines", row - 1)
        before = F.decode(F.substring("_raw", (first + 1).cast("int"), (byte - first).cast("int")), "UTF-8")
        return F.struct(row.alias("row"), (F.length(F.regexp_replace(before, r"[\r\n]+$", "")) + 1).alias("col"))

    rows = rows.withColumns({"_a": place(F.col("start")), "_z": place(F.col("stop"))})
    names = {"filename": F.col("doc"), "row": F.col("_a.row"), "col": F.col("_a.col"), "end_row": F.col("_z.row"), "end_col": F.col("_z.col")}
    return rows.withColumns(names).drop("_a", "_z", "_raw", "lines")


def escaped(text: Column) -> Column:
    """Line ends and backslashes spelled out."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def concise(d: DataFrame) -> DataFrame:
    """One line per diagnostic, in canonical order."""
    related = F.when(F.size("related") > 0, F.concat(F.lit(" ["), F.array_join(F.array_sort("related"), ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.col("filename"), F.lit(":"), F.col("row"), F.lit(":"), F.col("col"), F.lit(": "), F.col("code"), F.lit(" "), escaped(F.col("message")), related)
    return canonical(d).select(*ORDER, line.alias("line"))


def as_json(d: DataFrame) -> DataFrame:
    """One canonical JSON object per diagnostic."""
    return canonical(d).select(F.to_json(F.struct(*sorted(d.columns))).alias("json"))


def github(d: DataFrame) -> DataFrame:
    """Annotation commands; columns only where the span is on one line."""
    data = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    prop = lambda c: F.replace(F.replace(data(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    one = F.col("row") == F.col("end_row")
    columns = F.when(one, F.concat(F.lit(",col="), F.col("col"), F.lit(",endColumn="), F.greatest(F.col("end_col") - 1, F.col("col")))).otherwise("")
    line = F.concat(F.lit("::error file="), prop(F.col("filename")), F.lit(",line="), F.col("row"), F.lit(",endLine="), F.col("end_row"), columns, F.lit(",title="), F.col("code"), F.lit("::"), data(F.col("message")))
    return d.select(*ORDER, line.alias("line")).orderBy(*ORDER)


def rule_index(d: DataFrame) -> DataFrame:
    """Codes with their place in the sorted list of codes; one row per code."""
    codes = d.groupBy("code").agg(F.count("*").alias("n"))
    return codes.withColumn("rule_index", (F.dense_rank().over(Window.orderBy("code")) - 1).cast("long"))


def artifact_uri(filename: Column) -> Column:
    """A file's name as a URI: unreserved characters and / stay, the rest is percent-encoded UTF-8."""
    path = F.replace(filename, F.lit("\\"), F.lit("/"))
    coded = F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    drive = path.rlike("^[A-Za-z]:/")
    coded = F.when(drive, F.regexp_replace(F.replace(coded, F.lit("*"), F.lit("%2A")), "^(.)%3A", "$1:")).otherwise(F.replace(coded, F.lit("*"), F.lit("%2A")))
    return F.concat(F.when(drive, "file:///").when(F.startswith(path, F.lit("/")), "file://").otherwise(""), coded)


def sarif_results(d: DataFrame) -> DataFrame:
    """One SARIF result object per diagnostic, as JSON, in canonical order.

    With columns start and stop, regions have byte offsets; with ``edits``
    (start, stop, replacement), results have fixes of byte edits in base64.
    """
    at = {"byteOffset": F.col("start"), "byteLength": F.col("stop") - F.col("start")} if "start" in d.columns else {}
    region = F.struct(F.col("row").alias("startLine"), F.col("col").alias("startColumn"), F.col("end_row").alias("endLine"), F.col("end_col").alias("endColumn"), *[c.alias(n) for n, c in at.items()])
    uri = F.struct(artifact_uri(F.col("filename")).alias("uri"))
    where = F.struct(uri.alias("artifactLocation"), region.alias("region"))
    # Codes are joined by value: their index is one row each.
    rows = d.join(rule_index(d).select("code", "rule_index"), "code")
    parts = [F.col("code").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.lit("error").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(where.alias("physicalLocation"))).alias("locations")]
    if "edits" in d.columns:
        put = lambda e: F.struct(
            F.struct(e["start"].alias("byteOffset"), (e["stop"] - e["start"]).alias("byteLength")).alias("deletedRegion"),
            F.struct(F.base64(F.encode(e["replacement"], "UTF-8")).alias("binary")).alias("insertedContent"),
        )
        change = F.struct(uri.alias("artifactLocation"), F.transform(F.array_sort(F.array_distinct("edits")), put).alias("replacements"))
        fix = F.array(F.struct(F.struct(F.lit("Remove unused suppression codes.").alias("text")).alias("description"), F.array(change).alias("artifactChanges")))
        parts.append(F.when(F.size("edits") > 0, fix).alias("fixes"))
    return canonical(rows).select(F.to_json(F.struct(*parts)).alias("json"))


def text(d: DataFrame, docs: DataFrame) -> DataFrame:
    """Blocks of text, one per diagnostic in canonical order: a header, the lines it spans, and what is related; ``docs`` has (filename, text)."""
    rows = d.join(docs.select("filename", F.split("text", r"\r\n|\r|\n", -1).alias("_lines")), "filename", "left")
    last = F.when((F.col("end_row") > F.col("row")) & (F.col("end_col") == 1), F.col("end_row") - 1).otherwise(F.col("end_row")).cast("int")
    width = F.length(last.cast("string"))
    shown = F.transform(F.sequence(F.col("row").cast("int"), last), lambda r: F.concat(F.lit(" "), F.lpad(r.cast("string"), width, F.lit(" ")), F.lit(" | "), F.coalesce(F.get("_lines", r - 1), F.lit(""))))
    blank = F.concat(F.lit(" "), F.repeat(F.lit(" "), width), F.lit(" |"))
    header = F.concat(F.col("filename"), F.lit(":"), F.col("row"), F.lit(":"), F.col("col"), F.lit(": "), F.col("code"), F.lit(" "), escaped(F.col("message")))
    notes = F.transform(F.array_sort("related"), lambda x: F.concat(F.lit("   = related: "), x.cast("string")))
    block = F.concat(F.array(header), F.when(F.col("_lines").isNotNull(), F.concat(F.array(blank), shown, F.array(blank))).otherwise(F.array().cast("array<string>")), notes)
    return canonical(rows).select(F.array_join(block, "\n").alias("block"))


def footer(d: DataFrame) -> DataFrame:
    n = F.count("*")
    return d.agg(F.when(n == 0, "No diagnostics.").when(n == 1, "Found 1 diagnostic.").otherwise(F.concat(F.lit("Found "), n, F.lit(" diagnostics."))).alias("line"))


def policy_report(policies: DataFrame, enabled: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """One row per file in order: configuration, kind, domain, enabled rules, why it is left out, and its suppressions' states."""
    rules = enabled.groupBy("doc").agg(F.array_sort(F.collect_list("code")).alias("enabled_rules"))
    left_out = F.when(~F.col("included"), "include").when(F.col("excluded"), "exclude")
    kind = F.col("kind") if "kind" in policies.columns else F.lit(None).cast("string")
    rows = policies.join(rules, "doc", "left").withColumn("left_out", left_out)
    if states is not None:
        told = states.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("code", "state"))).alias("suppressions"))
        rows = rows.join(told, "doc", "left")
    more = ["suppressions"] if states is not None else []
    listed = F.when(F.col("left_out").isNull(), F.coalesce("enabled_rules", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("doc").alias("filename"), "config", kind.alias("kind"), "domain", "site_root", listed.alias("enabled_rules"), F.col("left_out").alias("excluded"), *more).orderBy("filename")


def enabled_count(enabled: DataFrame) -> DataFrame:
    """How many rules are enabled over all files."""
    return enabled.agg(F.count("*").alias("enabled_rules"))


def index_dump(shredded: DataFrame, policies: DataFrame, resolved: DataFrame) -> DataFrame:
    """One JSON object per document in order: kind, domain, language, anchors, identifiers and links with where they lead."""
    where = F.struct("idx", F.col("destination").alias("raw"), "start", "stop", "status", "target", "anchor")
    led = resolved.groupBy("doc").agg(F.array_sort(F.collect_list(where)).alias("links"))
    rows = shredded.select("doc", "language", "anchors", "identifiers").join(policies.select("doc", "kind", "domain", "canonical"), "doc").join(led, "doc", "left")
    none = F.array().cast(led.schema["links"].dataType)
    return rows.orderBy("doc").select(F.to_json(F.struct(F.col("doc").alias("filename"), "kind", "domain", "language", "canonical", "anchors", "identifiers", F.coalesce("links", none).alias("links"))).alias("json"))


def parse_report(shredded: DataFrame) -> DataFrame:
    """One row per document in order: language, counts of what it holds, and the roles of its sections."""
    counts = [F.size(n).alias(n) for n in ("sections", "blocks", "sentences", "links", "comments", "identifiers", "anchors")]
    roles = F.transform("sections", lambda s: F.struct(s["idx"].alias("section"), s["role"].alias("role"), s["signal"].alias("signal")))
    return shredded.select(F.col("doc").alias("filename"), "language", *counts, F.coalesce(F.size("front.errors"), F.lit(0)).alias("front_errors"), roles.alias("roles")).orderBy("filename")


def ordered_errors(errors: DataFrame) -> DataFrame:
    """Errors (filename, message), each once, in order."""
    return errors.select("filename", "message").distinct().orderBy("filename", "message")


def statistics(d: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Diagnostics per code; with suppression states (code, state), their numbers beside."""
    counted = d.groupBy("code").agg(F.count("*").alias("n"))
    if states is None:
        return counted.orderBy("code")
    told = states.groupBy("code").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("active", "stale", "incomplete", "invalid", "rule_disabled")])
    return counted.join(told, "code", "full_outer").na.fill(0).orderBy("code")


def exit_code(d: DataFrame, errors: DataFrame) -> DataFrame:
    """2 if anything failed to read, else 1 if anything was found, else 0."""
    # Two counts, summed as one row each.
    found = d.agg(F.count("*").alias("d"), F.lit(0).alias("e")).unionByName(errors.agg(F.lit(0).alias("d"), F.count("*").alias("e"))).agg(F.sum("d").alias("d"), F.sum("e").alias("e"))
    return found.select(F.when(F.col("e") > 0, 2).when(F.col("d") > 0, 1).otherwise(0).alias("exit_code"))
