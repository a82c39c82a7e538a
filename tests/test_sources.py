"""Sources over files written by the test."""

import zipfile
from email.message import EmailMessage

from pyspark.sql import functions as F

from inkveil.functions.config import resolve
from inkveil.operators import batch, tabular
from inkveil.operators.detect import redact
from inkveil.sources import containers, files
from inkveil.streaming.detect import counts_by_window, redact_stream


def make(folder):
    (folder / "a.txt").write_bytes("é mail a@b.com\nx".encode())
    (folder / "l.txt").write_bytes(b"caf\xe9 (555) 010-9999")
    (folder / "t.csv").write_bytes(b'ssn,name\r\n000554444,"x, ""y"""\r\nshort\r\n')
    (folder / "p.bin").write_bytes(b"%PDF-1.7")
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@b.com", "c@d.com", "hi"
    m.set_content("call (555) 010-9999")
    m.add_attachment(b"z", maintype="text", subtype="plain", filename="s.txt")
    (folder / "m.eml").write_bytes(bytes(m))
    ns = 'xmlns:w="w"'
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>SSN</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>000-55-4444</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(folder / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Accounts"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>SSN</t></is></c></row><row><c r="A2"><v>000554444</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(folder / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="a" href="1.xhtml"/></manifest><spine><itemref idref="gone"/><itemref idref="a"/></spine></package>')
        z.writestr("O/1.xhtml", "<p>a@b.com</p>")
    (folder / "bad.docx").write_bytes(b"PK\x03\x04 not a zip")


def test_files(spark, tmp_path):
    make(tmp_path)
    found = files.scan(spark, f"file://{tmp_path}")
    kinds = {r.name: (r.kind, r.code) for r in found.withColumn("kind", files.route(found.name, found.content)).withColumn("code", files.refusal(files.route(found.name, found.content), found.name)).collect()}
    assert kinds == {"a.txt": ("text", None), "l.txt": ("text", None), "t.csv": ("csv", None), "p.bin": ("pdf", 4), "m.eml": ("email", None), "d.docx": ("office", None), "s.xlsx": ("excel", None), "b.epub": ("epub", None), "bad.docx": ("office", None)}
    texts = {r.path.rpartition("/")[2]: r.redacted for r in redact(files.text_units(found.where("name like '%.txt'")), resolve()).collect()}
    assert texts == {"a.txt": "é mail ███████\nx", "l.txt": "café ████████████"}
    cells = tabular.redact_cells(tabular.with_headers(files.delimited_cells(found.where("name = 't.csv'")), "path"), resolve())
    assert files.delimited_text(cells).first().text == 'ssn,name\r\n█████████,"x, ""y"""\r\nshort\r\n'


def test_containers(spark, tmp_path):
    make(tmp_path)
    found = files.scan(spark, f"file://{tmp_path}")
    rows = containers.units(found.where("name not like '%.txt' and name not like '%.csv'")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rpartition("/")[2], []).append((r.surface, r.header, r.text, bool(r.error)))
    assert by["d.docx"] == [("body", None, "one\nSSN | 000-55-4444", False)]
    assert ("cell", "SSN", "000554444", False) in by["s.xlsx"] and ("title", None, "Accounts", False) in by["s.xlsx"]
    assert by["b.epub"] == [("html", None, "<p>a@b.com</p>", False)]
    assert ("header", None, "a@b.com", False) in by["m.eml"] and by["bad.docx"][0][3] and by["p.bin"][0][3]
    mail = containers.messages(found.where("name = 'm.eml'")).first()
    assert mail.attachments[0]["name"] == "s.txt"


def test_tables_with_wide_cells_blank_lines_and_errors(spark, tmp_path):
    wide = "x" * 200_000
    (tmp_path / "w.csv").write_text(f"a,b\n\n1,{wide}\n")
    (tmp_path / "n.csv").write_bytes(b"a\0b,c\n")
    (tmp_path / "bad.csv").write_bytes(b'a,b\n"open')
    cells = files.delimited_cells(files.scan(spark, f"file://{tmp_path}"))
    by = {}
    for r in cells.orderBy("path", "row", "col").collect():
        by.setdefault(r.path.rpartition("/")[2], []).append((r.row, r.col, r.text, bool(r.error)))
    assert by["w.csv"] == [(1, 0, "a", False), (1, 1, "b", False), (2, None, None, False), (3, 0, "1", False), (3, 1, wide, False)]
    done = tabular.redact_cells(tabular.with_headers(cells, "path"), resolve())
    texts = {r.path.rpartition("/")[2]: r.text for r in files.delimited_text(done).collect()}
    assert texts["w.csv"] == f"a,b\r\n\r\n1,{wide}\r\n"
    assert {r.path.rpartition("/")[2]: r.unit_count for r in files.counted_units(cells).collect()}["w.csv"] == 4


def mail(subject, *attached):
    m = EmailMessage()
    m["From"], m["Subject"] = "a@b.com", subject
    m.set_content(f"body of {subject}")
    for name, content in attached:
        if isinstance(content, EmailMessage):
            m.add_attachment(content)
        else:
            m.add_attachment(content, maintype="application", subtype="octet-stream", filename=name)
    return m


def test_mails_in_mails(spark, tmp_path):
    deep = mail("four", ("x.txt", b"not reached"))
    for subject in ("three", "two", "one"):
        deep = mail(subject, (None, deep), (f"{subject}.txt", f"ssn 000-55-4444 in {subject}".encode()))
    (tmp_path / "top.eml").write_bytes(bytes(deep))
    (tmp_path / "broken.eml").write_bytes(b"Content-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain; charset=nope\n\nhi\n--x--\n")
    found = batch.attached_files(files.scan(spark, f"file://{tmp_path}")).collect()
    texts = {r.name: bytes(r.content) for r in found if r.name.endswith(".txt") and r.content}
    assert sorted(texts.values()) == sorted(f"ssn 000-55-4444 in {s}".encode() for s in ("one", "two", "three"))
    assert "top_att2_one.txt" in texts and {r.depth for r in found} == {0, 1, 2}
    assert [r.skip for r in found if r.depth == 2 and r.name.endswith(".eml")] == ["mails are opened to 2 levels"]
    read = containers.messages(files.scan(spark, f"file://{tmp_path}")).collect()
    assert all(r.error is None or not r.attachments for r in read) and len(read) == 2


def test_sheets_by_relationship_nested_tables_and_losses(spark, tmp_path):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{rel}"><sheets><sheet name="First" r:id="b"/><sheet name="Second" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></R>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><c r="A1"><v>1</v></c><c r="AB2"><f>A1*2</f></c><c r="B1" t="b"><v>1</v></c></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet><c r="A1"><f>1+1</f><v>2</v></c></worksheet>')
        z.writestr("xl/drawings/drawing1.xml", "<x/>")
    w = 'xmlns:w="w"'
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>ner</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "n.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>{inner}</w:tc></w:tr></w:tbl><w:txbxContent/></w:body></w:document>")
        z.writestr("word/header2.xml", f"<w:hdr {w}><w:p><w:r><w:t>even</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:type="separator"><w:p><w:r><w:t>---</w:t></w:r></w:p></w:footnote><w:footnote><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>')
        z.writestr("word/media/image1.png", b"x")
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    with zipfile.ZipFile(tmp_path / "p.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<p:sld xmlns:p="p" xmlns:a="{a}" xmlns:c="c"><p:grpSp><p:sp><a:p><a:r><a:t>title</a:t></a:r></a:p></p:sp></p:grpSp><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc></a:tr></a:tbl><c:chart/></p:sld>')
    found = files.scan(spark, f"file://{tmp_path}")
    rows = [(r.path.rpartition("/")[2], r.unit, r.surface, r.text) for r in containers.units(found).collect()]
    assert ("r.xlsx", "First!A1", "cell", "2") in rows and ("r.xlsx", "Second!B1", "cell", "True") in rows
    texts = {(p, s): t for p, _, s, t in rows if p != "r.xlsx"}
    assert texts == {("n.docx", "header"): "even", ("n.docx", "body"): "a\tb / in | ner", ("n.docx", "notes"): "note", ("p.pptx", "slide"): "title\nx | y"}
    cells = containers.workbook_cells(found.where("name = 'r.xlsx'"))
    lost = tabular.uncached_formulas(cells.select("path", "sheet", "row", "col", F.col("formula").alias("text")), cells.where("text is not null").select("path", "sheet", "row", "col", "text"), "path", "sheet")
    assert [(r.sheet, r.n_uncached) for r in lost.where("n_uncached > 0").collect()] == [("Second", 1)]
    assert {(r.path.rpartition("/")[2], r.element, r.n) for r in containers.losses(found).collect()} == {("r.xlsx", "drawings", 1), ("n.docx", "text boxes", 1), ("n.docx", "pictures", 1), ("p.pptx", "charts", 1)}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a@b.com c@d.com"), ("2024-01-01 02:10:00", "x")], "t string, text string").selectExpr("timestamp(t) ts", "text")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert redact_stream(stream, resolve()).isStreaming
    q = counts_by_window(stream, resolve()).writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.category, r.n) for r in spark.table("found").collect()] == [("email", 2)]
