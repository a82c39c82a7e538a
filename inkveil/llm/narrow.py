"""Joins of wide rows with a table of ids, where rows that the table can't name are not shuffled.

The ids are marked in a bitmap of SLOTS words of 64 bits, a Bloom filter with
one hash. It has at most SLOTS rows however many ids there are, so it may be
broadcast. It never misses an id; what it lets through by chance, the join
that follows sorts out. The more ids, the more rows pass: it saves less then,
but the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the broadcast bitmap at most, of 16 bytes each.
SLOTS = 1 << 20
_HASH = "xxhash64(cast(doc_id as bigint))"
_SLOT = f"{_HASH} & {SLOTS - 1}L"
_BIT = f"shiftleft(1L, cast(shiftrightunsigned({_HASH}, 32) & 63 as int))"


def _marked(rows: DataFrame, ids: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """``rows`` beside the bitmap of ``ids``, and whether a row's doc_id may be among them."""
    new = max(rows.columns, key=len)  # longer names can't clash
    slot, bits = f"{new}_slot", f"{new}_bits"
    marks = ids.select(F.expr(_SLOT).alias(slot), F.expr(_BIT).alias("bit")).groupBy(slot).agg(F.bit_or("bit").alias(bits))
    return rows.join(F.broadcast(marks), F.expr(_SLOT) == F.col(slot), how), F.coalesce(F.col(bits).bitwiseAND(F.expr(_BIT)) != 0, F.lit(False))


def named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ``ids`` (a table, as it is read twice). A null doc_id is in no table.

    An inner join with distinct ids, as the optimizer would move a semi-join below the bitmap.
    """
    joined, may = _marked(rows, ids, "inner")
    return joined.where(may).select(*rows.columns).join(ids.select("doc_id").distinct(), "doc_id").select(*rows.columns)


def split(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose doc_id is surely not in ``ids``, and the others (a null doc_id is in either)."""
    joined, may = _marked(rows, ids, "left")
    return joined.where(~may).select(*rows.columns), joined.where(may).select(*rows.columns)


def unnamed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``ids`` (a table, as it is read twice). Rows with a null doc_id stay."""
    clear, rest = split(rows, ids)
    mark = max(rows.columns, key=len) + "_mark"
    listed = ids.select("doc_id").distinct().withColumn(mark, F.lit(True))
    return clear.union(rest.join(listed, "doc_id", "left").where(F.col(mark).isNull()).select(*rows.columns))
