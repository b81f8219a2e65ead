"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset a folder under /tmp serves, but only in local mode.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    ``release`` also frees the shuffle files behind it now: Spark deletes them
    once the driver's garbage collector has seen that nothing refers to them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    if release:
        _collect(spark)
    return spark.read.schema(schema).parquet(path).withMetadata(df.columns[0], {"path": path}) if df.columns else df


def settle(spark: SparkSession) -> None:
    """Frees the shuffle files of the last write too, which Spark's scheduler holds until another job has run."""
    spark.range(0, 1, 1, 1).collect()
    _collect(spark)


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes the files behind a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = df.schema[0].metadata.get("path")
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
