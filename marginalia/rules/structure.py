"""Rules over front matter, blocks and sections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import KINDS

# What makes a preamble long.
PREAMBLE_LINES, PREAMBLE_TABLE_LINES, RATIONALE_PARAGRAPHS, RATIONALE_CHARS = 30, 10, 2, 160


def resolved_kind(front: Column, mapped: Column) -> Column:
    """The kind of a document: what its front matter declares, else what a mapping gives; null if neither is valid."""
    declared = front["kind"]
    valid = F.when(declared.isin(*[k for k in KINDS if k != "generated"]), declared)
    return F.when(front.isNotNull() & (F.size(front["errors"]) > 0), None).when(declared.isNotNull(), valid).otherwise(mapped)


def kinds(shredded: DataFrame, mapped: DataFrame) -> DataFrame:
    """KND001: no kind, or front matter that cannot be read; KND002: an unknown kind, or one that only a mapping may give.

    ``mapped`` has (doc, kind). The span is the front matter's, or empty.
    """
    rows = shredded.select("doc", "front").join(mapped.select("doc", "kind"), "doc", "left")
    declared = F.col("front.kind")
    broken = F.col("front").isNotNull() & (F.size("front.errors") > 0)
    code = (
        F.when(broken, "KND001").when(declared.isNull() & F.col("kind").isNull(), "KND001")
        .when(declared.isNotNull() & (~declared.isin(*KINDS) | (declared == "generated")), "KND002")
    )
    rows = rows.select("doc", code.alias("code"), F.coalesce("front.start", F.lit(0)).cast("long").alias("start"), F.coalesce("front.stop", F.lit(0)).cast("long").alias("stop"))
    return rows.where("code is not null")


def flows(shredded: DataFrame) -> DataFrame:
    """Rows (doc, flow_start, flow_stop, opaque, unsure): each document's first main flow, and whether it is certain.

    It is not where there is none, or where HTML or code before it may hide another.
    """
    recovery = lambda b: F.exists("sections", lambda s: (s["idx"] == b["section"]) & s["recovery"])
    flow = F.array_min(F.transform(F.filter("blocks", lambda b: b["flow"] & ~recovery(b)), lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))))
    rows = shredded.withColumn("flow", flow).withColumn("opaque", F.array_min(F.transform(F.filter("blocks", lambda b: b["opaque"]), lambda b: b["start"])))
    start = F.col("flow.start")
    hidden = F.exists("blocks", lambda b: b["unclassified"] & ~recovery(b) & F.coalesce(b["start"] < start, F.lit(True)))
    unsure = start.isNull() | F.coalesce(F.col("opaque") < start, F.lit(False)) | hidden
    return rows.withColumn("unsure", unsure).withColumn("flow_start", start.cast("long")).withColumn("flow_stop", F.col("flow.stop").cast("long"))


def _spans(rows: DataFrame, code: str, spans: Column) -> DataFrame:
    out = rows.select("doc", F.lit(code).alias("code"), F.explode(spans).alias("span"), "flow_start", "flow_stop")
    return out.select("doc", "code", F.col("span.start").cast("long").alias("start"), F.col("span.stop").cast("long").alias("stop"), "flow_start", "flow_stop")


def _span(x: Column, first: str = "start", last: str = "stop") -> Column:
    return F.struct(x[first].alias("start"), x[last].alias("stop"))


def preambles(shredded: DataFrame, codes: set[str], languages: Iterable[str] = ("en", "zh", "ja")) -> tuple[DataFrame, DataFrame]:
    """RAT001, ORD001 and ORD002 on what stands before the first main flow, and MIX001.

    Diagnostics have (doc, code, start, stop, flow_start, flow_stop), the latter
    null for MIX001; incomplete rows (doc, code) are documents without a certain flow.
    """
    enabled = F.array(*map(F.lit, languages))
    every = flows(shredded.where(F.col("language").isin(*languages)))
    argues = lambda b: (b["kind"] == "paragraph") & F.arrays_overlap(b["rationale"], enabled)
    rows = every.where("not unsure").withColumn("before", F.filter("blocks", lambda b: (b["stop"] <= F.col("flow_start")) & ~b["quoted"]))
    out = []
    if "RAT001" in codes:
        told = rows.withColumn("reasons", F.filter("before", argues))
        chars = F.aggregate("reasons", F.lit(0), lambda a, b: a + F.length(b["prose"]))
        told = told.where((F.size("reasons") >= RATIONALE_PARAGRAPHS) & (chars >= RATIONALE_CHARS))
        out.append(_spans(told, "RAT001", F.array(_span(F.get("reasons", F.lit(0))))))
    if "ORD001" in codes:
        told = rows.withColumn("text", F.filter("before", lambda b: b["kind"].isin("paragraph", "table")))
        lines = F.size(F.array_distinct(F.flatten(F.transform("text", lambda b: b["rows"]))))
        table = F.try_element_at(F.filter("text", lambda b: (b["kind"] == "table") & (F.size(b["rows"]) > PREAMBLE_TABLE_LINES)), F.lit(-1))
        paragraph = F.get(F.filter("text", lambda b: b["kind"] == "paragraph"), F.lit(0))
        told = told.withColumn("table", table).where((lines > PREAMBLE_LINES) | F.col("table").isNotNull())
        span = F.coalesce(F.when(F.col("table").isNotNull(), _span(F.col("table"))), F.when(paragraph.isNotNull(), _span(paragraph)), F.col("flow"))
        out.append(_spans(told, "ORD001", F.array(span)))
    if "ORD002" in codes:
        above = lambda s: F.exists("sections", lambda t: (t["idx"] == s["parent"]) & t["recovery"])
        early = F.filter("sections", lambda s: (s["role"] == "troubleshooting") & (s["head_start"] < F.col("flow_start")) & ~above(s))
        out.append(_spans(rows, "ORD002", F.transform(early, lambda s: _span(s, "head_start", "head_stop"))))
    if "MIX001" in codes:
        decided = lambda s: s["decides"] | F.exists("blocks", lambda b: (b["section"] == s["idx"]) & argues(b))
        mixed = F.filter("sections", lambda s: (s["role"] == "rationale") & s["heading"].isNotNull() & (s["paragraphs"] >= RATIONALE_PARAGRAPHS) & decided(s))
        none = every.withColumn("flow_start", F.lit(None).cast("long")).withColumn("flow_stop", F.lit(None).cast("long"))
        out.append(_spans(none, "MIX001", F.transform(mixed, lambda s: _span(s, "head_start", "head_stop"))))
    left = [F.when(F.col("unsure"), F.lit(c)) for c in ("RAT001", "ORD001", "ORD002") if c in codes]
    left += [F.when(F.col("opaque").isNotNull(), F.lit("MIX001"))] if "MIX001" in codes else []
    undecided = every.select("doc", F.explode(F.filter(F.array(*left), lambda c: c.isNotNull())).alias("code"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found, undecided
