"""Detection for SQL: a function and a table function over texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, resolve
from .matcher import find

MATCHES = "array<struct<category:string,matched:string>>"


def register(spark: SparkSession, config: Config | None = None) -> None:
    """Make pii_matches(text), an array, and detect_pii(text), rows of (category, matched), known to the session's SQL.

    SQL passes Python no expressions, so these match in Python; DataFrames use
    :mod:`~inkveil.operators.detect`, which finds the same.
    """
    chosen = config or resolve()

    @F.pandas_udf(MATCHES)
    def pii_matches(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"category": c, "matched": m} for c, m in find(t, chosen)])

    @F.udtf(returnType="category string, matched string")
    class DetectPii:
        def eval(self, text: str) -> Iterator[tuple[str, str]]:
            yield from find(text, chosen)

    spark.udf.register("pii_matches", pii_matches)
    spark.udtf.register("detect_pii", DetectPii)
