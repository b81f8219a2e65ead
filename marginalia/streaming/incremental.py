"""Incremental checks: changed documents arrive as a stream (an addition)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.workspace import overlaid


def latest(batch: DataFrame) -> DataFrame:
    """The last change of each file in a batch (filename, text, version)."""
    last = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("version")))
    return batch.withColumn("_n", last).where("_n = 1").drop("_n")


def upsert_stream(changes: DataFrame, state: str, checkpoint: str, on_batch: Callable[[DataFrame, DataFrame], None]) -> StreamingQuery:
    """Folds changed files into versions of a table under ``state``, and calls
    ``on_batch(documents, changed)`` after each batch.

    A batch writes a version of its own number, so a batch that runs again
    replaces what it wrote.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = latest(batch).select("filename", "text")
        docs = overlaid(spark.read.parquet(f"{state}/{number - 1}"), changed) if number else changed
        docs.write.mode("overwrite").parquet(f"{state}/{number}")
        on_batch(spark.read.parquet(f"{state}/{number}"), changed)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visible(diagnostics: DataFrame, changed: DataFrame) -> DataFrame:
    """Diagnostics whose file, or a related one (related: array of filenames), changed."""
    names = changed.select(F.col("filename").alias("changed")).distinct()
    about = diagnostics.withColumn("_id", F.xxhash64(*diagnostics.columns))
    touched = about.select("_id", F.explode(F.concat(F.array("filename"), "related")).alias("changed")).join(names, "changed").select("_id").distinct()
    return about.join(touched, "_id", "left_semi").drop("_id")


def events(raw: DataFrame) -> DataFrame:
    """Editor events (value: JSON with a file's path and text) as changed files (filename, text); others are dropped."""
    told = F.from_json("value", "tool_input struct<file_path:string,content:string>, file_path string, content string")
    rows = raw.select(told.alias("e")).select(F.coalesce("e.tool_input.file_path", "e.file_path").alias("filename"), F.coalesce("e.tool_input.content", "e.content").alias("text"))
    return rows.where("filename is not null")
