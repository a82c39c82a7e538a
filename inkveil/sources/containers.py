"""Scan units of zipped and mail containers, read with the standard library in Arrow UDFs."""

from __future__ import annotations

import email
import email.message
import email.policy
import html
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

UNITS = "path string, unit_ord int, unit string, surface string, header string, text string, error string"
_COLUMNS = ["unit_ord", "unit", "surface", "header", "text", "error"]
_HIDDEN, _ANY_TAG = re.compile(r"(?is)<(script|style)\b[^>]*>.*?</\1>"), re.compile(r"<[^>]+>")
Unit = tuple[str, str, str | None, str]


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


#: What stands for white space in a run.
_BLANKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def _texts(node, names=("t",)) -> str:
    return "".join((x.text or "") if _tag(x) in names else _BLANKS.get(_tag(x), "") for x in node.iter())


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [n for n in z.namelist() if re.fullmatch(pattern, n)]
    return sorted(found, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])


def _paragraphs(root, paragraph: str = "p", row: str = "tr", cell: str = "tc") -> Iterator[str]:
    """Paragraphs in order; a table row is one line, cells joined by bars, what a cell holds (tables too) by slashes."""
    for node in root:
        if _tag(node) == paragraph:
            yield _texts(node)
        elif _tag(node) == row:
            yield " | ".join(" / ".join(_paragraphs(c, paragraph, row, cell)).replace("\n", " / ").strip() for c in node if _tag(c) == cell)
        else:
            yield from _paragraphs(node, paragraph, row, cell)


def docx(content: bytes) -> Iterator[Unit]:
    """Headers of all variants, body, notes (without separators), footers."""
    z = zipfile.ZipFile(io.BytesIO(content))
    for pattern, surface in ((r"word/header\d*\.xml", "header"), (r"word/document\.xml", "body"), (r"word/(?:foot|end)notes\.xml", "notes"), (r"word/footer\d*\.xml", "footer")):
        for name in _parts(z, pattern):
            root = ElementTree.fromstring(z.read(name))
            if surface == "notes":
                root = [x for x in root if not any(k.rpartition("}")[2] == "type" for k in x.attrib)]
            yield name, surface, None, "\n".join(_paragraphs(root))


def pptx(content: bytes) -> Iterator[Unit]:
    """Slides, with groups and tables, and their notes."""
    z = zipfile.ZipFile(io.BytesIO(content))
    for pattern, surface in ((r"ppt/slides/slide\d+\.xml", "slide"), (r"ppt/notesSlides/notesSlide\d+\.xml", "notes")):
        for name in _parts(z, pattern):
            yield name, surface, None, "\n".join(_paragraphs(ElementTree.fromstring(z.read(name))))


def odt(content: bytes) -> Iterator[Unit]:
    z = zipfile.ZipFile(io.BytesIO(content))
    root = ElementTree.fromstring(z.read("content.xml"))
    yield "content.xml", "body", None, "\n".join("".join(p.itertext()) for p in root.iter() if _tag(p) in ("p", "h"))


def _attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _elements(source, tag: str, root: str) -> Iterator[ElementTree.Element]:
    """Elements of a name, one at a time, of a document whose outermost is ``root``; what has been read is let go."""
    open_: list[ElementTree.Element] = []
    for event, x in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            if not open_ and _tag(x) != root:
                return
            open_.append(x)
            continue
        open_.pop()
        if _tag(x) == tag:
            yield x
        if open_ and not any(_tag(o) == tag for o in open_):
            open_[-1].remove(x)


def sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[ElementTree.Element]]]:
    """Title and cells of each sheet, hidden ones too; a part is found by the workbook's relationships, without them by its number."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    listed = [x for x in book.iter() if _tag(x) == "sheet"]
    rels = "xl/_rels/workbook.xml.rels"
    by_id = {_attribute(x, "Id"): x.get("Target", "") for x in ElementTree.fromstring(z.read(rels))} if rels in z.namelist() else {}
    numbered = _parts(z, r"xl/worksheets/sheet\d+\.xml")
    for i, x in enumerate(listed):
        # Of a sheet's attributes the relationship is the one in a namespace.
        target = by_id.get(next((v for k, v in x.attrib.items() if k.endswith("}id")), None))
        part = (target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")) if target else numbered[i] if i < len(numbered) else None
        if part is None or part not in z.namelist():
            raise ValueError(f"sheet {x.get('name')!r} has no part")
        with z.open(part) as source:  # chart sheets have no cells
            yield x.get("name", ""), _elements(source, "c", "worksheet")


def cells(content: bytes) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """Cells of a workbook: sheet, row, column from 1, value as text, formula. Either may be None, not both."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(x) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    for title, found in sheets(z):
        for c in found:
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            column = reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0)
            value = next((x.text for x in c if _tag(x) == "v"), None)
            kind = c.get("t")
            text = _texts(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else {"0": "False", "1": "True"}.get(value, value) if kind == "b" else value
            formula = next((f"={x.text or ''}" for x in c if _tag(x) == "f"), None)
            if text is not None or formula is not None:
                yield title, int(row), column, text, formula


def letters(column: int) -> str:
    """A column's name: 1 is A, 27 is AA."""
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def xlsx(content: bytes) -> Iterator[Unit]:
    """Cells of all sheets, hidden ones too, with row 1 as header; comments, sheet titles, defined names of book and sheets, properties."""
    z = zipfile.ZipFile(io.BytesIO(content))
    heads: dict[tuple[str, int], str] = {}
    for title, row, column, text, _ in cells(content):
        if text is None:
            continue
        if row == 1:
            heads[title, column] = text.strip()
        yield f"{title}!{letters(column)}{row}", "cell", heads.get((title, column)) if row > 1 else None, text
    for name in _parts(z, r"xl/comments\d*\.xml"):
        for c in (x for x in ElementTree.fromstring(z.read(name)).iter() if _tag(x) == "comment"):
            yield f"{name}!{c.get('ref')}", "comment", None, _texts(c)
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    for x in (x for x in book.iter() if _tag(x) == "sheet"):
        yield x.get("name", ""), "title", None, x.get("name", "")
    for x in (x for x in book.iter() if _tag(x) == "definedName"):
        yield x.get("name", ""), "name", None, f"{x.get('name', '')} {x.text or ''}"
    if "docProps/core.xml" in z.namelist():
        for x in ElementTree.fromstring(z.read("docProps/core.xml")):
            if x.text:
                yield _tag(x), "property", None, x.text


def epub(content: bytes) -> Iterator[Unit]:
    """Chapters in spine order; items that the manifest lacks are passed over. Protected books are refused."""
    z = zipfile.ZipFile(io.BytesIO(content))
    if {"META-INF/rights.xml", "META-INF/encryption.xml"} & set(z.namelist()):
        raise ValueError("protected book")
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(x.get("full-path") for x in box.iter() if _tag(x) == "rootfile")
    package = ElementTree.fromstring(z.read(opf))
    manifest = {x.get("id"): x.get("href") for x in package.iter() if _tag(x) == "item"}
    spine = [manifest[x.get("idref")] for x in package.iter() if _tag(x) == "itemref" and x.get("idref") in manifest]
    if not spine:
        raise ValueError("no chapters")
    base = opf.rpartition("/")[0]
    for href in spine:
        name = f"{base}/{href}" if base else href
        yield name, "html", None, z.read(name).decode("utf-8", "replace")


Attachment = tuple[str, bytes, str | None]


def _attached(part) -> Attachment:
    """Name, bytes and why there are none. An attached mail is its own source, texts are UTF-8."""
    name = part.get_filename() or "attachment"
    try:
        held = part.get_content()
        if isinstance(held, email.message.Message):
            return (name if "." in name else f"{name}.eml"), held.as_bytes(), None
        return name, held.encode("utf-8", "replace") if isinstance(held, str) else held, None
    except Exception as e:  # noqa: BLE001  whatever a broken part does, it is reported
        return name, b"", f"could not be decoded: {type(e).__name__}"


def message(content: bytes) -> tuple[dict[str, str], str, list[Attachment]]:
    """Headers, best body (plain before HTML, which loses its tags and has its entities decoded) and attachments of a mail."""
    m = email.message_from_bytes(content, policy=email.policy.default)
    heads = {h: str(m[h]) for h in ("From", "To", "Cc", "Subject", "Date") if m[h]}
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = html.unescape(_ANY_TAG.sub(" ", _HIDDEN.sub(" ", text)))
    return heads, text, [_attached(a) for a in m.iter_attachments()]


def eml(content: bytes) -> Iterator[Unit]:
    heads, body, _ = message(content)
    for name, value in heads.items():
        yield name, "header", None, value
    yield "body", "body", None, body


READERS: dict[str, Callable[[bytes], Iterator[Unit]]] = {".docx": docx, ".pptx": pptx, ".odt": odt, ".xlsx": xlsx, ".epub": epub, ".eml": eml}


_CHUNK = 10_000


def _chunks(read: Callable[[], Iterator[tuple]]) -> Iterator[list[tuple]]:
    """What a reader gives, some rows at a time. It is read to its end before the first rows are given, so an error comes in their stead."""
    rows = read()
    first = list(islice(rows, _CHUNK))
    more = False
    for _ in rows:
        more = True
    yield first
    if more:
        rows = islice(read(), _CHUNK, None)
        while some := list(islice(rows, _CHUNK)):
            yield some


def units(files: DataFrame) -> DataFrame:
    """Scan units of containers. One that cannot be read gives a row with the error, never silence."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, name, content in zip(pdf["path"], pdf["name"], pdf["content"], strict=True):
                read = READERS.get("." + name.lower().rpartition(".")[2])
                try:
                    if read is None:
                        raise ValueError("unsupported format")
                    for rows in _chunks(lambda: ((i, *u, None) for i, u in enumerate(read(bytes(content))))):  # noqa: B023  used up before the next
                        yield pd.DataFrame(rows, columns=_COLUMNS).assign(path=path)[["path", *_COLUMNS]]
                except Exception as e:  # noqa: BLE001  whatever a broken file does, it is reported
                    rows = [(0, "file", "error", None, None, f"{type(e).__name__}: {e}")]
                    yield pd.DataFrame(rows, columns=_COLUMNS).assign(path=path)[["path", *_COLUMNS]]

    return files.select("path", "name", "content").mapInPandas(work, UNITS)


def messages(files: DataFrame) -> DataFrame:
    """Mails with their attachments: path, body, attachments (name, blob, skip), error. A mail that cannot be read has an error and no attachments."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    _, body, found = message(bytes(content))
                    rows.append((path, body, [{"name": n, "blob": b, "skip": why} for n, b, why in found], None))
                except Exception as e:  # noqa: BLE001  whatever a broken mail does, it is reported
                    rows.append((path, None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "body", "attachments", "error"])

    return files.select("path", "content").mapInPandas(work, "path string, body string, attachments array<struct<name:string,blob:binary,skip:string>>, error string")


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks with values and formulas side by side; a broken book has one row with the error."""
    names = ["path", "sheet", "row", "col", "text", "formula", "error"]

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for rows in _chunks(lambda: ((path, *c, None) for c in cells(bytes(content)))):  # noqa: B023  used up before the next
                        yield pd.DataFrame(rows, columns=names).astype({"row": "Int32", "col": "Int32"})
                except Exception as e:  # noqa: BLE001  whatever a broken book does, it is reported
                    yield pd.DataFrame([(path, None, None, None, None, None, f"{type(e).__name__}: {e}")], columns=names).astype({"row": "Int32", "col": "Int32"})

    return files.select("path", "content").mapInPandas(work, "path string, sheet string, row int, col int, text string, formula string, error string")


#: What no reader takes up, counted in the source of some parts: extension, parts, what it is called, opening tags.
_LOST = (
    (".docx", r"word/(?:document|header\d*|footer\d*)\.xml", "text boxes", "<w:txbxContent"),
    (".docx", r"word/(?:document|header\d*|footer\d*)\.xml", "alternate contents", "<mc:AlternateContent"),
    (".docx", r"word/(?:document|header\d*|footer\d*)\.xml", "embedded objects", "<w:object"),
    (".pptx", r"ppt/slides/slide\d+\.xml", "charts", "<c:chart"),
    (".pptx", r"ppt/slides/slide\d+\.xml", "diagrams", "<dgm:relIds"),
)


def lost(name: str, content: bytes) -> dict[str, int]:
    """Elements of a container that its reader leaves out, by what they are."""
    z, out = zipfile.ZipFile(io.BytesIO(content)), {}
    for extension, pattern, what, tag in _LOST:
        if name.lower().endswith(extension):
            out[what] = sum(z.read(part).decode("utf-8", "replace").count(tag) for part in _parts(z, pattern))
    if name.lower().endswith(".xlsx"):
        out["drawings"] = len(_parts(z, r"xl/drawings/[^/]*\.xml"))
    if name.lower().endswith((".docx", ".pptx")):
        out["pictures"] = len(_parts(z, r"(?:word|ppt)/media/.*"))
    if name.lower().endswith(".epub"):
        out["chapters without text"] = sum(not _ANY_TAG.sub(" ", text).strip() for _, _, _, text in epub(content))
    return {k: n for k, n in out.items() if n}


def losses(files: DataFrame) -> DataFrame:
    """What readers leave out of each container, never in silence: path, element, n."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, name, content in zip(pdf["path"], pdf["name"], pdf["content"], strict=True):
                try:
                    rows += [(path, k, n) for k, n in lost(name, bytes(content)).items()]
                except Exception:  # noqa: BLE001  units() has the error of a broken file
                    rows.append((path, "unreadable", 1))
            yield pd.DataFrame(rows, columns=["path", "element", "n"])

    return files.select("path", "name", "content").mapInPandas(work, "path string, element string, n long")
