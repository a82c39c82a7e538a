"""Files as pages: matches with their places, counts, pages that could not be read, and readers for what is not text.

A page is a row (file_id, page_no, text, links array<string>, has_images). No
library here draws or reads PDF, images or codes, so such readers are passed in
as functions; without them, files and pages are reported as not read, never as
clean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import squeeze
from ..functions.config import Config
from .detect import exploded, matches

PAGES = "file_id string, page_no int, text string, links array<string>, has_images boolean, error string"
_PLACED = "array<struct<category:string,matched:string,places:array<int>,located:boolean>>"


def read_pages(files: DataFrame, read: Callable[[str, bytes], list[tuple[str, list[str], bool]]] | None = None) -> DataFrame:
    """Pages of files (path, name, content). read gives text, links and whether there are images, for each page; an error, or no reader, is a row with the reason."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, name, content in zip(pdf["path"], pdf["name"], pdf["content"], strict=True):
                try:
                    if read is None:
                        raise ValueError("no reader for this format")
                    rows = [(path, i, text, links, images, None) for i, (text, links, images) in enumerate(read(name, bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  whatever a broken file does, it is reported
                    rows = [(path, 0, None, [], False, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["file_id", "page_no", "text", "links", "has_images", "error"])

    return files.select("path", "name", "content").mapInPandas(work, PAGES)


def add_ocr(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Adds page_text and ocr: where a page has images and no text, the best candidate of found (file_id, page_no, candidate, confidence), if it has any text."""
    blank = (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0) & F.col("has_images")
    if found is None:
        return pages.withColumn("page_text", F.coalesce("text", F.lit(""))).withColumn("ocr", F.lit(False))
    best = best_candidate(found, "file_id", "page_no").withColumnRenamed("candidate", "read")
    wide = pages.join(best.select("file_id", "page_no", "read"), ["file_id", "page_no"], "left")
    use = blank & (F.length(F.trim(F.coalesce("read", F.lit("")))) > 0)
    return wide.withColumn("page_text", F.when(use, F.col("read")).otherwise(F.coalesce("text", F.lit("")))).withColumn("ocr", use).drop("read")


def best_candidate(found: DataFrame, *keys: str) -> DataFrame:
    """Of each key the candidate of the highest confidence; of equal ones the first in order."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "candidate")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def places(text: Column, matched: Column) -> Column:
    """Where a string is in a text, from 1, not overlapping; if nowhere, where its white space may be any."""
    literal = F.concat(F.lit(r"\Q"), F.replace(matched, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    loose = F.array_join(F.transform(F.split(squeeze(matched), " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+")

    def of(pattern: Column) -> Column:
        parts = F.split(text, pattern, -1)
        found = F.regexp_extract_all(text, pattern, F.lit(0))
        sizes = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
        return F.transform(found, lambda m, i: (1 + F.length(F.get(parts, i)) + F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, n: s + n)).cast("int"))

    exact = of(literal)
    return F.when(F.contains(text, matched), exact).otherwise(of(loose))


def locate(pages: DataFrame, config: Config, text: str = "page_text") -> DataFrame:
    """Adds found: distinct matches of each page with their places; one without is not located."""
    each = F.transform(matches(F.col(text), config), lambda m: F.struct(m.category.alias("category"), m.matched.alias("matched"), places(F.col(text), m.matched).alias("places")))
    return pages.withColumn("found", F.transform(each, lambda m: F.struct(m.category.alias("category"), m.matched.alias("matched"), m.places.alias("places"), (F.size(m.places) > 0).alias("located"))).cast(_PLACED))


def page_counts(located: DataFrame, *keys: str) -> DataFrame:
    """Matches by category as pages count them: each place of a distinct match, and one where it has none."""
    rows = exploded(located, *keys, m="found")
    return rows.groupBy(*keys, F.col("m.category").alias("category")).agg(F.sum(F.greatest(F.size("m.places"), F.lit(1))).cast("long").alias("n"))


def link_counts(pages: DataFrame, config: Config, *keys: str) -> DataFrame:
    """Links whose target holds a match; they are deleted whole."""
    hit = pages.select(*keys, F.explode("links").alias("uri")).where(F.size(matches(F.col("uri"), config)) > 0)
    return hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit("link").alias("category"), "n")


def outside_counts(found: DataFrame, *keys: str) -> DataFrame:
    """Faces, handwriting and codes that readers from outside report (kind, one row each), as counts by category."""
    return found.where(F.col("kind").isin("face", "handwriting", "barcode")).groupBy(*keys, F.col("kind").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def page_sets(pages: DataFrame, key: str, outside: DataFrame | None = None) -> DataFrame:
    """Of each file page_count and the sorted pages that are scanned (images, but no text was read), read by OCR, with images, with codes, seen by vision; counts of faces and handwriting."""
    page = F.col("page_no")
    blank = F.length(F.trim("page_text")) == 0
    set_of = lambda ok, name: F.array_sort(F.collect_set(F.when(ok, page))).alias(name)
    out = pages.groupBy(key).agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.length(F.trim("page_text"))).alias("total_text_chars"), set_of(blank & F.col("has_images"), "scanned_pages"), set_of(F.col("ocr"), "ocr_pages"), set_of(F.col("has_images"), "image_pages"))
    if outside is None:
        none = F.array().cast("array<int>")
        return out.withColumns({"barcode_pages": none, "vision_pages": none, "faces": F.lit(0).cast("long"), "handwriting": F.lit(0).cast("long")})
    kind = F.col("kind")
    seen = outside.groupBy(key).agg(set_of(kind == "barcode", "barcode_pages"), set_of(kind.isin("face", "handwriting"), "vision_pages"), F.count_if(kind == "face").alias("faces"), F.count_if(kind == "handwriting").alias("handwriting"))
    wide = out.join(seen, key, "left")
    filled = {c: F.coalesce(c, F.array().cast("array<int>")) for c in ("barcode_pages", "vision_pages")} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("faces", "handwriting")}
    return wide.withColumns(filled)


def exit_code(remaining: Column, scanned: Column, chars: Column) -> Column:
    """3 where matches remain, 2 where a page, or all there is, could not be read, else 0."""
    return F.when(remaining > 0, 3).when((F.size(scanned) > 0) | (F.coalesce(chars, F.lit(0)) == 0), 2).otherwise(0)


def summary(pages: DataFrame, config: Config, key: str = "file_id", outside: DataFrame | None = None, remaining: DataFrame | None = None) -> DataFrame:
    """What :func:`~.reports.page_report` tells of each file. pages: with page_text and ocr; remaining: key, category, remaining."""
    located = locate(pages, config)
    counts = page_counts(located, key).unionByName(link_counts(pages, config, key))
    if outside is not None:
        counts = counts.unionByName(outside_counts(outside, key))
    listed = lambda rows, name, *c: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    found = exploded(located, key, "page_no", m="found").select(key, F.col("page_no").alias("page"), "m.category", "m.matched", "m.located")
    wide = page_sets(pages, key, outside).join(listed(counts, "counts", "category", "n"), key, "left").join(listed(found, "matches", "page", "category", "matched", "located"), key, "left")
    wide = wide.join(listed(remaining, "remaining", "category", "remaining"), key, "left") if remaining is not None else wide.withColumn("remaining", F.lit(None).cast("array<struct<category:string,remaining:bigint>>"))
    left = F.coalesce(F.size("remaining"), F.lit(0))
    empty = {"attachments": F.array().cast("array<string>"), "titles_redacted": F.lit(0), "dropped": F.lit(0), "notes": F.array().cast("array<string>")}
    return wide.withColumns(empty).withColumn("exit_code", exit_code(left, F.col("scanned_pages"), F.col("total_text_chars")))
