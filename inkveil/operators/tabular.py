"""Cells of tables: each is scanned alone and with its column's header as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import Config
from .detect import fold, longest_first, matches


def melt(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A typed table as cells (key, col, header, text); numbers are scanned as written."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(c).alias("header"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns)])
    return table.select(F.col(key).alias("row"), F.explode(cells).alias("c")).select("row", "c.*")


def with_headers(cells: DataFrame, *keys: str) -> DataFrame:
    """Gives cells (keys, row, col, text) the text of row 1 of their column; row 1 itself has none."""
    heads = cells.where("row = 1").select(*keys, "col", F.col("text").alias("header"))
    return cells.join(heads, [*keys, "col"], "left").withColumn("header", F.when(F.col("row") > 1, F.col("header")))


def headers_by_window(cells: DataFrame, *keys: str) -> DataFrame:
    """The same by window, where a file's columns are few."""
    head = F.first(F.when(F.col("row") == 1, F.col("text")), ignorenulls=True).over(Window.partitionBy(*keys, "col").orderBy("row"))
    return cells.withColumn("header", F.when(F.col("row") > 1, head))


def cell_matches(text: Column, header: Column, config: Config) -> Column:
    """Hits in the cell, then hits of "header: cell" that lie in the cell; longest first."""
    bare = matches(text, config)
    context = F.filter(matches(F.concat(header, F.lit(": "), text), config), lambda x: F.contains(text, x.matched))
    wide = F.when(F.coalesce(F.length(header), F.lit(0)) > 0, F.array_distinct(F.concat(bare, context))).otherwise(bare)
    return longest_first(wide)


def redact_cells(cells: DataFrame, config: Config) -> DataFrame:
    """Adds matches, redacted and hits to cells with header and text, with the detectors for tables."""
    found = cells.withColumn("matches", cell_matches(F.col("text"), F.col("header"), config.tabular()))
    done = found.withColumn("_fold", fold(F.col("text"), F.col("matches")))
    return done.withColumn("redacted", F.coalesce("_fold.text", "text")).withColumn("hits", F.col("_fold.hits")).drop("_fold")


def uncached_formulas(formulas: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """Formula cells whose file holds no value, by keys: they cannot be scanned."""
    return formulas.where("text like '=%'").join(values.select(*keys, "row", "col", F.col("text").alias("value")), [*keys, "row", "col"], "left").groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("n_uncached"))
