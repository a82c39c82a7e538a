"""Routing by content, and mails with HTML bodies only."""

import zipfile
from email.message import EmailMessage

from inkveil.sources import containers, files


def test_text_by_content_and_zips_by_mimetype(spark, tmp_path):
    ole = bytes.fromhex(files.OLE2)
    (tmp_path / ".dot.txt").write_bytes(b"not seen")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "_in.txt").write_bytes(b"not seen")
    for name, content in {"_hid.txt": b"a@b.com", "p.cr3": b"\xff\xd8", "o.xls": ole, "o.msg": b"x", "o.docx": ole, "o.bin": ole, "m.xlsm": b"PK\x03\x04", "a.cfg": "é a@b.com".encode(), "README": b"x", "s.py": b"x = 1", "sheet.xls": b"a\tb", "n.odt": b"text", "raw.bin": b"\xff\xfe\x00", "cut": b"a" * 4095 + "é".encode(), "old.doc": b"text"}.items():
        (tmp_path / name).write_bytes(content)
    for name, kind in {"t.odt": "application/vnd.oasis.opendocument.text", "f.odt": "application/epub+zip", "t.epub": "application/epub+zip\n", "f.epub": "application/zip", "z.zip": ""}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("first", "x")
            z.writestr("mimetype", kind)
    found = files.scan(spark, f"file://{tmp_path}")
    kind = files.route(found.name, found.content)
    got = {r.name: (r.kind, r.code) for r in found.withColumn("kind", kind).withColumn("code", files.refusal(kind, found.name)).collect()}
    text, none = ("text", None), ("unsupported", 4)
    assert got == {"a.cfg": text, "README": text, "_hid.txt": text, "s.py": text, "sheet.xls": text, "n.odt": none, "raw.bin": none, "cut": none, "old.doc": ("legacy_office", 4), "t.odt": ("legacy_office", None), "f.odt": none, "t.epub": ("epub", None), "f.epub": none, "z.zip": none, "p.cr3": ("image", 4), "o.xls": ("office_binary", 4), "o.msg": ("email", 4), "o.docx": ("encrypted_office", 5), "o.bin": none, "m.xlsm": none}
    assert {r.name: bytes(r.content) for r in found.where("name like '#_%' escape '#'").collect()} == {"_hid.txt": b"a@b.com"}


def test_html_mail(spark, tmp_path):
    m = EmailMessage()
    m["From"] = "a@b.com"
    m.set_content("<style>p {}</style><p>mail c&#64;d.com, call <b>(555)</b> 010&#45;9999</p>", subtype="html")
    (tmp_path / "m.eml").write_bytes(bytes(m))
    rows = {r.unit: r.text for r in containers.units(files.scan(spark, f"file://{tmp_path}")).collect()}
    assert " ".join(rows["body"].split()) == "mail c@d.com, call (555) 010-9999"
