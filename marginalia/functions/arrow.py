"""Arrow maps that keep Python workers small."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a batch on its way to a Python worker.
ARROW_BYTES = "4m"


def trim() -> None:
    """Gives a Python worker's free memory back: workers live on between tasks, beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of ARROW_BYTES, with free memory given back at the end of each partition.

    The batch size is a setting of the session and stays.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(whole, schema)
