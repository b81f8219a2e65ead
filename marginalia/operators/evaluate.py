"""Evaluation: precision, diffs, samples and gates over stored diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision(labels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Counts and precisions per group; conservative precision counts uncertain labels as wrong."""
    tp, fp = F.count_if(F.col(label) == "tp"), F.count_if(F.col(label) == "fp")
    unsure = F.count_if(F.col(label) == "uncertain")
    return labels.groupBy(*by).agg(
        tp.alias("tp"), fp.alias("fp"), unsure.alias("uncertain"),
        F.round(F.try_divide(tp.cast("double"), tp + fp), 6).alias("precision"),
        F.round(F.try_divide(tp.cast("double"), tp + fp + unsure), 6).alias("conservative"),
    )


def with_empty_groups(rolled: DataFrame, dimensions: DataFrame, by: list[str]) -> DataFrame:
    """Adds the groups that ``dimensions`` lists and the data lack, with zero counts."""
    return dimensions.join(rolled, by, "left").fillna(0, ["tp", "fp", "uncertain"])


def gate(rolled: DataFrame, least: int = 100, precision_at: float = 0.95) -> DataFrame:
    n = F.col("tp") + F.col("fp") + F.col("uncertain")
    return rolled.withColumn("promoted", (n >= least) & F.coalesce(F.col("conservative") >= precision_at, F.lit(False)))


def confusion(rows: DataFrame, predicted: str, reviewed: str) -> DataFrame:
    return rows.groupBy(predicted, reviewed).agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    same = F.count_if(F.col(a).eqNullSafe(F.col(b)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(same / F.count("*"), 6).alias("agreement"))


def diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows added, removed and changed between two reports."""
    b = before.select(*key, F.col(value).alias("old"), F.lit(True).alias("_b"))
    a = after.select(*key, F.col(value).alias("new"), F.lit(True).alias("_a"))
    joined = b.join(a, key, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.withColumn("change", change).where("change is not null").select(*key, "change", "old", "new")


def introduced(before: DataFrame, after: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """Multiset difference that keeps the rows: those of ``after`` beyond the count in ``before``."""
    n = F.row_number().over(Window.partitionBy(*signature).orderBy(*order))
    a, b = after.withColumn("_n", n), before.withColumn("_n", n).select(*signature, "_n")
    return a.join(b, [*signature, "_n"], "left_anti").drop("_n")


def noise(changes: DataFrame, diagnostics: DataFrame, change: str) -> DataFrame:
    """Changes with a diagnostic per 100 changes; clean changes count too."""
    total = changes.agg(F.count_distinct(change).alias("changes"))
    hit = diagnostics.groupBy("code").agg(F.count_distinct(change).alias("blocked"))
    return hit.join(F.broadcast(total), F.lit(True)).select("code", "blocked", "changes", F.round(100 * F.col("blocked") / F.col("changes"), 6).alias("per_100"))


def cumulative_stop(batches: DataFrame, order: str, count: str, stop: int) -> DataFrame:
    """Batches, already summed to one row each, up to the one that reaches ``stop``."""
    before = F.coalesce(F.sum(count).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return batches.withColumn("before", before.cast("long")).where(F.col("before") < stop)


def sweep(pairs: DataFrame, thresholds: list[float], weight: str | None = None) -> DataFrame:
    """Pairs at or above each threshold; the thresholds are a parameter, and rows are folded before they meet.

    A row counts as many times as its ``weight`` says, if one is named.
    """
    each = F.col(weight) if weight else F.lit(1)
    counts = [F.sum(F.when(F.col("shared") >= F.lit(t) * F.col("total") - 1e-9, each).otherwise(0)) for t in thresholds]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(str(i)) for i, c in enumerate(counts)]
    wide = pairs.agg(*counts)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(str(i)).alias("n_pairs")) for i, t in enumerate(thresholds)])
    return wide.select(F.inline(rows))


def frozen(diagnostics: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostics (doc, code, start, stop, message, related) as rows with an identity, a split and facts of their files.

    The identity is the SHA-256 of the diagnostic's canonical JSON with the
    digest of its file; ``files`` has (doc, source, text, and ``keys``).
    """
    chosen = files.select("doc", "source", F.sha2("text", 256).alias("input_sha256"), *keys)
    rows = diagnostics.join(chosen, "doc")
    body = F.to_json(F.struct(*sorted(c for c in ("code", "start", "stop", "message", "related") if c in diagnostics.columns)))
    split = F.when(F.conv(F.substring(F.sha2("source", 256), 1, 4), 16, 10).cast("int") % 5 == 0, "holdout").otherwise("calibration")
    return rows.withColumns({"diagnostic_sha256": F.sha2(body, 256), "split": split}).withColumn("id", F.sha2(F.concat_ws("|", "source", "doc", "input_sha256", "diagnostic_sha256"), 256))


def label_problems(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (id, problem) where labels (id, input_sha256, diagnostic_sha256, label) and frozen rows do not fit together."""
    both = rows.select("id", F.col("input_sha256").alias("i"), F.col("diagnostic_sha256").alias("d")).join(labels, "id", "full_outer")
    twice = labels.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("labelled twice").alias("problem"))
    problem = (
        F.when(F.col("label").isNull(), "no label").when(F.col("i").isNull(), "no diagnostic").when(~F.col("label").isin("tp", "fp", "uncertain"), "unknown label")
        .when((F.col("i") != F.col("input_sha256")) | (F.col("d") != F.col("diagnostic_sha256")), "changed since")
    )
    return both.select("id", problem.alias("problem")).where("problem is not null").distinct().unionByName(twice)


def disjoint(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that both have; a holdout must give none."""
    return first.select(key).intersect(second.select(key))


def scores(rows: DataFrame, by: list[list[str]]) -> DataFrame:
    """Precision for each grouping, with the share of all rows that a group holds and whether it is most of them."""
    total = rows.agg(F.count("*").alias("total"))
    out = None
    for group in by:
        part = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "tp").alias("tp"), F.count_if(F.col("label") == "fp").alias("fp"))
        part = part.select(F.lit("/".join(group)).alias("grouping"), F.concat_ws("/", *group).alias("value"), "n", "tp", "fp", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(total)).withColumn("dominates", F.col("n") * 2 > F.col("total")).drop("total")  # one row


def before_after(before: DataFrame, after: DataFrame, gold: DataFrame, key: list[str], value: str) -> DataFrame:
    """How many known values (``gold``) each of two classifications meets, and how many the second wins or loses."""
    rows = gold.select(*key, F.col(value).alias("_gold"))
    for name, df in (("_before", before), ("_after", after)):
        rows = rows.join(df.select(*key, F.col(value).alias(name)), key, "left")
    was, now = F.coalesce(F.col("_before") == F.col("_gold"), F.lit(False)), F.coalesce(F.col("_after") == F.col("_gold"), F.lit(False))
    return rows.agg(F.count("*").alias("known"), F.count_if(was).alias("before"), F.count_if(now).alias("after"), F.count_if(now & ~was).alias("won"), F.count_if(was & ~now).alias("lost"))


def unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other does not have as often; none, if both are equal."""
    names = left.columns
    gone = left.exceptAll(right.select(*names)).withColumn("side", F.lit("left"))
    return gone.unionByName(right.select(*names).exceptAll(left).withColumn("side", F.lit("right")))


def latencies(samples: DataFrame, by: str) -> DataFrame:
    """Median, least and greatest seconds of runs (seconds, output_sha256), and whether all gave the same output."""
    return samples.groupBy(by).agg(F.median("seconds").alias("median"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), (F.count_distinct("output_sha256") == 1).alias("same_output"))


def signature(excerpt, message: str = "message", code: str = "code"):
    """What names a diagnostic across revisions: its code, its excerpt with white space folded, and its message."""
    return F.sha2(F.concat_ws("\x00", F.col(code), F.trim(F.regexp_replace(excerpt, r"\s+", " ")), F.col(message)), 256)


def link_oracle(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Links (source, destination) whose written path, folded by name alone, is an entry (path) or a folder of one: a check of its own."""
    parts = F.split("path", "/")
    every = entries.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_at")).distinct()
    folder = F.split(F.regexp_extract("source", r"^(.*?)/?[^/]*$", 1), "/")
    raw = F.regexp_extract("destination", r"^([^?#]*)", 1)
    steps = F.when(F.startswith(raw, F.lit("/")), F.split(raw, "/")).otherwise(F.concat(folder, F.split(raw, "/")))
    walk = F.aggregate(
        F.filter(steps, lambda x: ~x.isin("", ".")), F.array().cast("array<string>"),
        lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, x)),
    )
    rows = links.where(~F.col("destination").rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")).withColumn("_at", F.array_join(walk, "/"))
    return rows.join(every.withColumn("exists", F.lit(True)), "_at", "left").withColumn("exists", F.coalesce("exists", F.lit(False)) | (F.col("_at") == "")).drop("_at")


def diff_markdown(changes: DataFrame, key: list[str], most: int = 80) -> DataFrame:
    """A diff (key, change, old, new) as lines of a Markdown table, the first ``most`` by key and then how many more there are."""
    n = changes.agg(F.count("*").alias("n"))
    rows = changes.orderBy(*key, "change").limit(most)
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.concat_ws(":", *key), cell("change"), cell("old"), cell("new")), F.lit(" |"))
    told = rows.select(F.lit(1).alias("part"), F.concat_ws(":", *key).alias("at"), line.alias("line"))
    more = n.where(F.col("n") > most).select(F.lit(2).alias("part"), F.lit("").alias("at"), F.concat(F.lit("... and "), F.col("n") - most, F.lit(" more")).alias("line"))
    return told.unionByName(more).orderBy("part", "at", "line").select("line")
