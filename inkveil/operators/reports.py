"""Reports: one text a file, for files that keep their format, for pages, and for what is combined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import LABELS, NOTES
from ..functions.checks import mask, squeeze, wrap
from .detect import dealt

#: Fixed value: what a report says where matches remain. The gate before combining looks for it.
FAIL = "*** FAIL"
_BAR, _RULE = "=" * 70, "-" * 70
_LINES = "array<string>"


def label(category: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.element_at(named, category), category)


def _lines(*texts: str | Column) -> Column:
    return F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts)).cast(_LINES)


def _section(title: str, body: Column) -> Column:
    """A titled part of a report; none where it has no lines."""
    whole = F.concat(_lines(_RULE, title, _RULE), body, _lines(""))
    return F.when(F.size(F.coalesce(body, _lines())) > 0, whole).otherwise(_lines())


def _or(lines: Column, otherwise: str) -> Column:
    return F.when(F.size(F.coalesce(lines, _lines())) > 0, lines).otherwise(_lines(otherwise))


def _listed(notes: Column, first: str) -> Column:
    """Notes, wrapped, each with a mark at its first line."""
    each = F.transform(notes, lambda n: F.transform(wrap(n, 66), lambda line, i: F.concat(F.when(i == 0, F.lit(first)).otherwise(F.lit(" " * len(first))), line)))
    return F.flatten(each)


def _counted(counts: Column) -> Column:
    return F.transform(counts, lambda x: F.format_string("  %-32s %4d match(es)", label(x.category), x.n))


def _verdict(left: Column, dry_run: bool) -> Column:
    if dry_run:
        return _lines("  Skipped: a dry run writes no output.")
    failed = F.concat(_lines(f"  {FAIL} *** the output, read again, still holds:"), F.transform(left, lambda x: F.format_string("    %s: %d", label(x.category), x.remaining)), _lines("  Do not pass this file on before someone has looked at it."))
    return F.when(F.size(F.coalesce(left, F.array().cast("array<struct<category:string,remaining:bigint>>"))) > 0, failed).otherwise(_lines("  PASS: the output was read again and scanned with the same detectors; 0 matches."))


def _per_file(rows: DataFrame, key: str, *columns: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def _by_category(rows: Column, n: str, value: Callable[[Column], Column]) -> Column:
    """(category, n) in order of (category, ...) rows; null where there are none."""
    of = lambda c: F.aggregate(F.filter(rows, lambda x: x.category == c), F.lit(0).cast("long"), lambda s, x: s + value(x))
    names = F.array_sort(F.array_distinct(F.transform(rows, lambda x: x.category)))
    return F.when(F.size(rows) > 0, F.transform(names, lambda c: F.struct(c.alias("category"), of(c).alias(n))))


def native_report(redacted: DataFrame, remaining: DataFrame | None, key: str, preset: str = "general", unit: str = "line", dry_run: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Reports of text files, tables and workbooks: key, report.

    redacted: key and hits (category, matched, n, line), a row for each unit.
    remaining: key, category, remaining; no rows pass. If it is None, redacted
    has the matches of each unit's output as a column ``remaining``, so texts
    are read, redacted and scanned again in one pass. facts: key, unit_count,
    notes (array), skipped (reason or null), one row a file that is to have a
    report. Matches are masked unless it is a dry run, which verifies nothing.
    """
    shown = squeeze if dry_run else mask
    # Units without a key are of no file: none of their matches is told.
    listed = lambda c: F.flatten(F.collect_list(F.when(F.col(key).isNotNull() & (F.size(c) > 0), F.col(c)))).alias(c)
    wide = redacted.groupBy(key).agg(*[listed(c) for c in ("hits", "remaining")[: 2 if remaining is None else 1]])
    if remaining is not None:
        wide = wide.join(_per_file(remaining.select(key, "category", F.col("remaining").cast("long").alias("remaining")), key, "category", "remaining", name="left"), key, "left")
    if facts is not None:
        wide = wide.join(facts.select(key, "unit_count", "notes", "skipped"), key, "full")
    else:
        wide = wide.withColumns({"unit_count": F.lit(None).cast("long"), "notes": F.lit(None).cast(_LINES), "skipped": F.lit(None).cast("string")})
    detail = F.transform("hits", lambda h: F.struct(h.line.alias("line"), label(h.category).alias("what"), shown(h.matched).alias("shown")))
    told = {"counts": _by_category(F.col("hits"), "n", lambda h: h.n), "detail": F.array_sort(detail)}
    if remaining is None:
        told["left"] = _by_category(F.col("remaining"), "remaining", lambda x: F.lit(1).cast("long"))
    wide = dealt(wide).withColumns(told)
    notes = F.concat(F.coalesce("notes", _lines()), F.when(F.col("skipped").isNotNull(), F.array(F.concat(F.lit("skipped: "), "skipped"))).otherwise(_lines()), _lines(NOTES[preset]))
    body = F.concat(
        _lines(_BAR, f"REDACTION {'DRY-RUN ' if dry_run else ''}REPORT", _BAR),
        F.array(F.concat(F.lit("File    : "), F.col(key).cast("string")), F.lit(f"Preset  : {preset}"), F.concat(F.lit("Scanned : "), F.coalesce(F.col("unit_count").cast("string"), F.lit("?")), F.lit(f" {unit}(s)")), F.lit("")),
        _section("MATCHES BY CATEGORY", _or(_counted(F.col("counts")), "  None of the enabled categories.")),
        _section(f"DETAIL ({unit}, category, matched text)", _or(F.transform("detail", lambda d: F.format_string("  %-14s %-28s %s", d.line.cast("string"), d.what, d.shown)), "  (none)")),
        _section("NOTES", _listed(notes, "  - ")),
        _section("POST-REDACTION VERIFICATION", _verdict(F.col("left"), dry_run)),
        _lines(_BAR),
    )
    return wide.select(key, F.array_join(body, "\n").alias("report"))


def page_report(files: DataFrame, key: str, preset: str = "general", dry_run: bool = False) -> DataFrame:
    """Reports of paged files: key, report.

    files: key, page_count, counts (array of category, n), matches (array of
    page, category, matched, located), remaining (array of category,
    remaining), attachments (array of names), titles_redacted, the arrays
    scanned_pages, ocr_pages, image_pages, barcode_pages, vision_pages, and
    faces, handwriting, dropped, notes, as :func:`~.pages.summary` gives them.
    """
    shown = squeeze if dry_run else mask
    pages = lambda c: F.concat(F.lit("pages "), F.array_join(F.transform(c, lambda p: p.cast("string")), ", "))
    when = lambda ok, *texts: F.when(F.coalesce(ok, F.lit(False)), F.array(*texts)).otherwise(_lines())
    flagged = F.array_except("image_pages", "barcode_pages")
    unlocated = F.exists("matches", lambda m: ~m.located)
    warnings = F.concat(
        when(F.size("scanned_pages") > 0, F.concat(F.lit("NOTHING WAS REDACTED on "), pages("scanned_pages"), F.lit(": they are images without text that could be read."))),
        when(unlocated, F.lit("Matches marked NOT LOCATED are in the text but have no place on the page and were not removed.")),
        when(F.size("barcode_pages") > 0, F.concat(F.lit("Codes were read and removed on "), pages("barcode_pages"), F.lit("."))),
        when(F.size(flagged) > 0, F.concat(F.lit("Images on "), pages(flagged), F.lit(": no code was read, but they may hold codes, signatures or scanned identifiers."))),
    )
    would = "would be " if dry_run else ""
    items = F.concat(
        when(F.size("attachments") > 0, F.concat(F.lit(f"  Attached files {would}removed unread: "), F.array_join("attachments", ", "))),
        when(F.col("titles_redacted") > 0, F.format_string(f"  Bookmark titles {would}replaced: %d", F.col("titles_redacted"))),
    )
    conversion = F.concat(when(F.col("dropped") > 0, F.format_string("  ! %d element(s) could not be converted and are left out.", F.col("dropped"))), _listed(F.coalesce("notes", _lines()), "  - "))
    vision = when(F.size("vision_pages") > 0, F.concat(F.lit("  "), pages("vision_pages"), F.format_string(": %d face(s), %d region(s) of handwriting.", F.col("faces"), F.col("handwriting"))))
    body = F.concat(
        _lines(_BAR, f"PAGE REDACTION {'DRY-RUN ' if dry_run else ''}REPORT", _BAR),
        F.array(F.concat(F.lit("File    : "), F.col(key).cast("string")), F.lit(f"Preset  : {preset}"), F.concat(F.lit("Pages   : "), F.col("page_count").cast("string")), F.lit("")),
        _section("CONVERSION", conversion),
        _section("MATCHES BY CATEGORY", _or(_counted(F.col("counts")), "  None of the enabled categories.")),
        _section("DETAIL (page, category, matched text)", _or(F.transform("matches", lambda m: F.format_string("  p.%-4d %-28s %s%s", m.page, label(m.category), shown(m.matched), F.when(m.located, F.lit("")).otherwise(F.lit("   << NOT LOCATED")))), "  (none)")),
        _section("DOCUMENT-LEVEL ITEMS", items),
        _section("OCR", when(F.size("ocr_pages") > 0, F.concat(F.lit("  Text was read from the images of "), pages("ocr_pages"), F.lit("; look at them.")))),
        _section("FACES AND HANDWRITING", vision),
        _section("WARNINGS", _or(_listed(warnings, "  ! "), "  None.")),
        _section("NOTES", _listed(_lines(NOTES[preset]), "  - ")),
        _section("POST-REDACTION VERIFICATION", _verdict(F.col("remaining"), dry_run)),
        _lines(_BAR),
    )
    return files.select(key, F.array_join(body, "\n").alias("report"))


def combined_report(ranges: DataFrame, remaining: DataFrame, group: str, name: str) -> DataFrame:
    """Reports of combined files: group, ok, report. ranges: group, name, label of pages; remaining: group, category, remaining."""
    left = _per_file(remaining.select(group, "category", F.col("remaining").cast("long").alias("remaining")), group, "category", "remaining", name="left")
    parts = _per_file(ranges, group, name, "label", name="parts").join(left, group, "left")
    body = F.concat(
        _lines(_BAR, "COMBINED REDACTION REPORT", _BAR),
        F.array(F.format_string("Files   : %d", F.size("parts")), F.lit("")),
        _section("CONTENTS (file, pages in the combined file)", F.transform("parts", lambda p: F.format_string("  %-50s %s", p[name], p.label))),
        _section("POST-REDACTION VERIFICATION", F.concat(_verdict(F.col("left"), False), F.when(F.col("left").isNotNull(), _lines("  The combined file was not written.")).otherwise(_lines()))),
        _lines(_BAR),
    )
    return parts.select(group, F.col("left").isNull().alias("ok"), F.array_join(body, "\n").alias("report"))
