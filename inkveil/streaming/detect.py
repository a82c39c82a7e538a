"""Detection over streams: the same expressions; only counts over time keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import Config
from ..operators.detect import exploded, redact


def redact_stream(stream: DataFrame, config: Config, text: str = "text") -> DataFrame:
    return redact(stream, config, text)


def counts_by_window(stream: DataFrame, config: Config, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", text: str = "text") -> DataFrame:
    """Occurrences by window and category; what comes later than the watermark is left out, as streams do."""
    done = redact(stream.withWatermark(ts, late), config, text)
    return exploded(done, ts, h="hits").groupBy(F.window(ts, width), F.col("h.category").alias("category")).agg(F.sum("h.n").alias("n"))
