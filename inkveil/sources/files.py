"""Files as tables: routing by content and name, text, delimited files."""

from __future__ import annotations

import csv
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import decode

# Extensions of each kind, and the first bytes of containers.
TEXT = (".txt", ".md", ".log", ".json", ".yaml", ".yml", ".xml", ".html", ".htm")
TABLES = (".csv", ".tsv")
PICTURES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff", ".heic", ".heif", ".avif", ".ico", ".psd")
CAMERA = (".cr2", ".cr3", ".nef", ".arw", ".dng")
MIMETYPES = {".odt": "application/vnd.oasis.opendocument.text", ".odp": "application/vnd.oasis.opendocument.presentation", ".epub": "application/epub+zip"}
OLE2, ZIP, PDF, RTF = "D0CF11E0A1B11AE1", "504B0304", "25504446", "7B5C727466"

FILES = "path string, name string, length long, content binary"


def _underscored(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Path and address of the folder's files whose names begin with an underscore: Spark's readers pass over them, even by name."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(top, "_*"))
    return [(str(f.getPath().toString()), str(f.getPath().toUri().toString())) for f in found or () if f.isFile()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files one at a time, through Arrow's file systems; one that cannot be read is an error, never left out."""
    for batch in batches:
        for path, address in zip(batch.column("path").to_pylist(), batch.column("address").to_pylist(), strict=True):
            system, place = filesystem(address)
            with system.open_input_stream(place) as f:
                content = f.read()
            yield pa.RecordBatch.from_pydict({"path": [path], "name": [path.rpartition("/")[2]], "length": [len(content)], "content": [content]})


def filesystem(address: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for an address, and the place in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", address) if ":" in address else f"file://{address}")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder, not of folders below, without names that begin with a dot: path, name, length, content."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.withColumn("name", name).where(~F.col("name").startswith(".")).select("path", "name", "length", "content")
    more = _underscored(spark, path)
    if not more:
        return files
    names = spark.createDataFrame(more, "path string, address string").repartition(min(len(more), spark.sparkContext.defaultParallelism))
    return files.union(names.mapInArrow(_read, FILES))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


@F.pandas_udf(T.StringType())
def _mimetype(content: pd.Series) -> pd.Series:
    """The mimetype entry of zips; null where there is none or the zip is not readable."""

    def read(x: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(x)) as z:
                return z.read("mimetype").decode("ascii", "replace").strip()
        except Exception:  # noqa: BLE001  a zip that cannot be read has no type
            return None

    return content.map(read, na_action="ignore").astype("object")


def route(name: Column, content: Column) -> Column:
    """The kind of a file, by its first bytes before its name; whatever its name, it is text if its first 4096 bytes are UTF-8.

    A character that the 4096th byte cuts counts as no UTF-8. Zips whose
    mimetype entry contradicts the name are unsupported; without the entry, the
    name decides.
    """
    head, ext = F.hex(F.substring(content, 1, 8)), extension(name)
    typed = F.create_map(*(F.lit(x) for pair in MIMETYPES.items() for x in pair))[ext]
    # Only zips of typed formats are passed to Python.
    other = F.coalesce(_mimetype(F.when(head.startswith(ZIP) & ext.isin(*MIMETYPES), content)) != typed, F.lit(False))
    return (
        F.when(head.startswith(PDF), "pdf")
        .when(head.startswith(RTF) | (ext == ".rtf"), "legacy_office")
        .when(ext == ".eml", "email")
        .when((head == OLE2) | ext.isin(".doc", ".msg"), F.when(ext == ".doc", "legacy_office").when(ext == ".msg", "email").when(ext.isin(".xls", ".ppt"), "office_binary").when(ext.isin(".docx", ".xlsx", ".pptx"), "encrypted_office").otherwise("unsupported"))
        .when(head.startswith(ZIP) & other, "unsupported")
        .when(head.startswith(ZIP), F.when(ext.isin(".docx", ".pptx"), "office").when(ext == ".xlsx", "excel").when(ext == ".odt", "legacy_office").when(ext == ".odp", "office_binary").when(ext == ".epub", "epub").otherwise("unsupported"))
        .when(ext.isin(*PICTURES, *CAMERA), "image")
        .when(ext.isin(*TABLES), "csv")
        .when(ext.isin(*TEXT) | (ext != ".odt") & F.is_valid_utf8(F.substring(content, 1, 4096).cast("string")), "text")
        .otherwise("unsupported")
    )


def refusal(kind: Column, name: Column) -> Column:
    """Exit code of files that are not read here: 5 encrypted, 4 unsupported, null for what is read."""
    own = (kind == "legacy_office") & (extension(name) == ".odt") | (kind == "email") & (extension(name) == ".eml")
    return F.when(kind == "encrypted_office", 5).when(kind.isin("unsupported", "pdf", "image", "office_binary") | kind.isin("legacy_office", "email") & ~own, 4)


def text_units(files: DataFrame) -> DataFrame:
    """A text file is one unit; a match may cross lines."""
    return files.select("path", F.lit(0).alias("unit_ord"), F.lit("file").alias("unit"), F.lit("text").alias("surface"), F.lit(None).cast("string").alias("header"), decode(F.col("content")).alias("text"))


def unit_lines(text: Column) -> Column:
    """Lines of a text, by every line break there is, a last empty one not counted."""
    ends = F.regexp_count(text, F.lit("\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"))
    return ends + F.when((F.length(text) > 0) & ~text.rlike("[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]\\z"), 1).otherwise(0)


#: Cells that a batch holds, and the columns of cells. A line without cells has one row whose col is null; a file that is no table has one row with the error.
PART = 10_000
CELLS = "path string, row int, col int, text string, error string"


def _parsed(path: str, name: str, text: str) -> Iterator[tuple]:
    csv.field_size_limit(sys.maxsize)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if name.lower().endswith(".tsv") else ",")
    try:
        for r, row in enumerate(rows, 1):
            yield from [(path, r, c, cell, None) for c, cell in enumerate(row)] or [(path, r, None, None, None)]
    except csv.Error as e:
        yield path, None, None, None, f"{type(e).__name__}: {e}"


def _cells(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for path, name, text in zip(pdf["path"], pdf["name"], pdf["text"], strict=True):
            found = _parsed(path, name, text)
            while part := list(islice(found, PART)):
                yield pd.DataFrame(part, columns=["path", "row", "col", "text", "error"]).astype({"row": "Int32", "col": "Int32"})


def delimited_cells(files: DataFrame) -> DataFrame:
    """Cells of delimited files; rows may differ in length. A file with an error has a row that says so."""
    return files.select("path", "name", decode(F.col("content")).alias("text")).mapInPandas(_cells, CELLS)


def delimited_text(cells: DataFrame, value: str = "redacted") -> DataFrame:
    """Cells back as the text of one file each; written with line ends \\r\\n and the fewest quotes. Files with an error have none."""
    broken = cells.where("error is not null").select("path").distinct()

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.StringIO()
        path = pdf["path"].iloc[0]
        writer = csv.writer(out, delimiter="\t" if path.lower().endswith(".tsv") else ",")
        for _, row in pdf.sort_values(["row", "col"]).groupby("row"):
            writer.writerow(row.loc[row["col"].notna(), value].tolist())
        return pd.DataFrame({"path": [path], "text": [out.getvalue()]})

    return cells.join(broken, "path", "left_anti").select("path", "row", "col", value).groupBy("path").applyInPandas(write, "path string, text string")


def counted_units(cells: DataFrame) -> DataFrame:
    """Cells of each file, empty ones too, as its report counts them."""
    return cells.groupBy("path").agg(F.count("col").alias("unit_count"))
