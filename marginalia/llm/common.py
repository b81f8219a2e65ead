"""Session helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import mapped, trim  # noqa: F401  for the operators of this package
from ..functions.tables import forget, fresh_path, shared_dir, written  # noqa: F401

#: Regular expression of a word; the byte kernels in ``words`` use the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hex_digest(column) -> F.Column:
    return F.sha2(column, 256)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links`` (a, b: long): rows (node, component).

    ``component`` is the smallest node that links reach. Every node of a link
    is returned once. Each round takes the smallest label among a node and its
    neighbours and then follows that label to its own label, so chains halve;
    labels are written to the shared folder between rounds. Rows with null
    ends are ignored. No row of a graph reaches the driver, only a count.
    """
    both = links.where("a is not null and b is not null")
    both = written(both.select("a", "b").unionByName(both.selectExpr("b as a", "a as b")).distinct(), name)
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), name)
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("seen"))
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = written(
            step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")),
            name,
        )
        changed = step.where("old <> label").limit(1).count()
        forget(labels)
        labels = step.drop("old")
        if not changed:
            forget(both)
            return labels.withColumnRenamed("label", "component")
