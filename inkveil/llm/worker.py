"""Arrow functions in Python workers that hold little: short batches in, and freed memory back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows, and bytes, of an Arrow batch at most: texts are long, and a batch is held on both sides.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_MMAP_THRESHOLD, _LARGE = -3, 4 << 20

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy() -> None:
    """Give what is free back to the system: an idle worker would keep it beside the next stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Work) -> Work:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with suppress(AttributeError, OSError):
            ctypes.CDLL(None).mallopt(_MMAP_THRESHOLD, _LARGE)
        try:
            yield from work(batches)
        finally:
            tidy()

    return run


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to LIMITS where they may be larger."""
    for key, most in LIMITS.items():
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def arrow(work: Work, schema: str | T.StructType) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: mapInArrow with :func:`lean`, over small batches."""

    def run(df: DataFrame) -> DataFrame:
        small_batches(df.sparkSession)
        return df.mapInArrow(lean(work), schema)

    return run
