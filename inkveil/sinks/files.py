"""Writers of text files, delimited files, workbooks and reports, and what reads each back to verify it.

Executors write through Arrow's file systems, so a folder may be local and
shared or in an object store. A file is written beside its name and then moved
there, so a task that runs again replaces it whole.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import output_name, sheet_title
from ..functions.config import Config
from ..operators import markup
from ..operators.batch import gate, page_ranges
from ..operators.detect import distinct_counts, matches
from ..operators.reports import combined_report
from ..operators.tabular import cell_matches, with_headers
from ..sources.containers import letters, units
from ..sources.files import delimited_cells, delimited_text, filesystem, scan, text_units

WRITTEN = "name string, path string, length long"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) into a folder. Lazy: the files are there once the result, a row each, has been computed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        for batch in batches:
            rows = {"name": [], "path": [], "length": []}
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                place = posixpath.join(top, name)
                system.create_dir(posixpath.dirname(place), recursive=True)
                draft = posixpath.join(posixpath.dirname(place), f".{uuid.uuid4().hex}")
                with system.open_output_stream(draft) as out:
                    out.write(content)
                system.move(draft, place)
                for key, value in (("name", name), ("path", place), ("length", len(content))):
                    rows[key].append(value)
            yield pa.RecordBatch.from_pydict(rows)

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(work, WRITTEN)


def _name(path: str = "path"):
    return F.regexp_extract(F.col(path), r"([^/]*)$", 1)


def text_files(redacted: DataFrame) -> DataFrame:
    """Redacted texts (path, redacted) as files, in UTF-8 whatever they were."""
    return redacted.select(output_name(_name()).alias("name"), F.encode("redacted", "UTF-8").alias("content"))


def delimited_files(cells: DataFrame) -> DataFrame:
    """Redacted cells as files, with the delimiter of each name."""
    return delimited_text(cells).select(output_name(_name()).alias("name"), F.encode("text", "UTF-8").alias("content"))


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _rows(cells: Iterable[tuple[int, int, str]]) -> Iterator[str]:
    """The rows of a sheet in XML, of cells that come in order, some at a time."""
    some, last = [], None
    for row, column, text in cells:
        if row != last:
            if len(some) > 5000:
                yield "".join(some)
                some.clear()
            some.append(f'{"</row>" if last is not None else ""}<row r="{row}">')
            last = row
        some.append(f'<c r="{letters(column)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
    yield "".join(some) + ("</row>" if last is not None else "")


def workbook(sheets: Iterable[tuple[str, Iterable[tuple[int, int, str]]]]) -> bytes:
    """A workbook of values only: sheets of (row, column, text), in order, each written as it is read. It has no properties, names, comments or formulas."""
    out, titles = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for title, cells in sheets:
            titles.append(title)
            with z.open(f"xl/worksheets/sheet{len(titles)}.xml", "w", force_zip64=True) as part:
                part.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for some in _rows(cells):
                    part.write(some.encode())
                part.write(b"</sheetData></worksheet>")
        n = range(1, len(titles) + 1)
        part = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{part}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(title)} sheetId="{i}" r:id="rId{i}"/>' for i, title in enumerate(titles, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
    return out.getvalue()


def workbook_files(cells: DataFrame, config: Config) -> DataFrame:
    """Redacted cells (path, sheet, row, col, redacted) as workbooks. Titles are redacted and cut to what a workbook takes; one that is taken gets a number."""
    titles = cells.select("path", "sheet").distinct().withColumn("matches", matches(F.col("sheet"), config))
    cut = F.aggregate("matches", F.col("sheet"), lambda t, m: F.replace(t, m.matched, F.repeat(F.lit("█"), F.least(F.length(m.matched), F.lit(12)))))
    titles = titles.select("path", "sheet", F.when(F.size("matches") > 0, sheet_title(cut, F.xxhash64("sheet") % 1000)).otherwise(F.col("sheet")).alias("title"))

    def sheets(rows: Iterator[tuple]) -> Iterator[tuple[str, Iterator[tuple[int, int, str]]]]:
        taken = set()
        for (_, title), some in groupby(rows, key=lambda r: (r[1], r[2])):
            name, i = title, 1
            while name.lower() in taken:
                i += 1
                name = f"{title[: 30 - len(str(i))]}~{i}"
            taken.add(name.lower())
            yield name, ((row, column, text) for _, _, _, row, column, text in some if text is not None)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Books of sorted cells, of which a batch at a time is held."""
        cells = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in order), strict=True))
        for path, rows in groupby(cells, key=lambda r: r[0]):
            yield pa.RecordBatch.from_pydict({"path": [path], "content": [workbook(sheets(rows))]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    order = ["path", "sheet", "title", "row", "col", "redacted"]
    whole = cells.select("path", "sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "redacted").join(titles, ["path", "sheet"]).select(*order)
    return whole.repartition("path").sortWithinPartitions(*order).mapInArrow(build, "path string, content binary").select(output_name(_name()).alias("name"), "content")


def report_files(reports: DataFrame, key: str) -> DataFrame:
    """Reports as logs/<name>_report.txt."""
    return reports.select(F.concat(F.lit("logs/"), _name(key), F.lit("_report.txt")).alias("name"), F.encode("report", "UTF-8").alias("content"))


def _remaining_text(files: DataFrame, config: Config) -> DataFrame:
    found = text_units(files).select("path", matches(F.col("text"), config).alias("matches"))
    return distinct_counts(found, "path").withColumnRenamed("n", "remaining")


def _remaining_pages(files: DataFrame, config: Config) -> DataFrame:
    return markup.verify_pages(text_units(files).select("path", F.col("text").alias("redacted")), config, "path")


def _remaining_cells(files: DataFrame, config: Config) -> DataFrame:
    cells = with_headers(delimited_cells(files), "path")
    found = cells.select("path", cell_matches(F.col("text"), F.col("header"), config.tabular()).alias("matches"))
    return distinct_counts(found, "path").withColumnRenamed("n", "remaining")


def _remaining_units(files: DataFrame, config: Config) -> DataFrame:
    found = units(files).select("path", cell_matches(F.col("text"), F.col("header"), config.tabular()).alias("matches"))
    return distinct_counts(found, "path").withColumnRenamed("n", "remaining")


@dataclass(frozen=True)
class Sink:
    """What a format is written with (None: elsewhere), and what reads its files again: files and configuration to path, category, remaining."""

    write: Callable[..., DataFrame] | None
    remaining: Callable[[DataFrame, Config], DataFrame]


#: Sinks by format. One without a reader for its outputs cannot be named here.
SINKS: dict[str, Sink] = {"text": Sink(text_files, _remaining_text), "page": Sink(text_files, _remaining_pages), "csv": Sink(delimited_files, _remaining_cells), "excel": Sink(workbook_files, _remaining_units)}


def register(name: str, sink: Sink) -> None:
    """Add a format; it must say how its outputs are read again."""
    if not callable(sink.remaining):
        raise TypeError(f"sink {name} has no reader for what it writes")
    SINKS[name] = sink


def verify_files(spark: SparkSession, folder: str, kind: str, config: Config, pattern: str = "%") -> DataFrame:
    """What the files of a folder still hold, by the sink's own reader: path, category, remaining. No rows is a pass."""
    return SINKS[kind].remaining(scan(spark, folder).where(F.col("name").like(pattern)), config)


def combine(outputs: DataFrame, reports: DataFrame, config: Config, folder: str) -> tuple[DataFrame, DataFrame]:
    """All texts of a group (group, name, text, pages) as one file, if every one has a report of a pass (name, report) and the whole, scanned again, holds nothing.

    Returns what was written and a report of each group; a group that may not
    be combined has a report, or (where a part has none or failed) no row.
    """
    blocked = gate(outputs, reports, "name").select("group").distinct()
    ranges = page_ranges(outputs, "group", "name", "pages")
    parts = F.sort_array(F.collect_list(F.struct("name", "text")))
    whole = outputs.join(blocked, "group", "left_anti").groupBy("group").agg(F.array_join(F.transform(parts, lambda p: p.text), "\f").alias("text"))
    left = distinct_counts(whole.select("group", matches(F.col("text"), config).alias("matches")), "group").withColumnRenamed("n", "remaining")
    told = combined_report(ranges.join(blocked, "group", "left_anti"), left, "group", "name")
    clean = whole.join(told.where("ok").select("group"), "group")
    files = clean.select(F.concat(F.col("group").cast("string"), F.lit("_combined_redacted.txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return write_files(files, folder), told
