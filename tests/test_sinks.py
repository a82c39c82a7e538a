"""Files written, read again and verified; pages; what may be combined."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from inkveil.functions.config import resolve
from inkveil.operators import pages, reports, tabular
from inkveil.operators.detect import redact, verify
from inkveil.sinks import files as sinks
from inkveil.sources import containers, files

PLANTED = ["a.b@x.com", "(555) 010-9999", "000-55-4444"]


def test_text_and_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.txt").write_bytes("caf\xe9 a.b@x.com (555) 010-9999, $12,345.67".encode("latin-1"))
    (tmp_path / "in" / "p.html").write_text("<a href='mailto:a.b@x.com'>a.b&#64;x.com</a> 000-55-4444 $12,345.67")
    found, out = files.text_units(files.scan(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/out"
    texts = redact(found.where("path like '%txt'"), resolve())
    written = sinks.write_files(sinks.text_files(texts), out).collect()
    assert [(r.name, r.length) for r in written] == [("t_redacted.txt", len((tmp_path / "out" / "t_redacted.txt").read_bytes()))]
    from inkveil.operators import markup

    page = markup.redact_pages(found.where("path like '%html'").select("path", F.col("text").alias("html")), resolve())
    sinks.write_files(sinks.text_files(page), out).collect()
    for name in ("t_redacted.txt", "p_redacted.html"):
        text = (tmp_path / "out" / name).read_text()
        assert "$12,345.67" in text and not any(p in text for p in PLANTED)
    assert sinks.verify_files(spark, out, "text", resolve(), "%.txt").count() == 0
    assert sinks.verify_files(spark, out, "page", resolve(), "%.html").count() == 0
    assert {r.category for r in sinks.verify_files(spark, f"file://{tmp_path}/in", "page", resolve(), "%.html").collect()} == {"email", "ssn"}


def test_tables_and_workbooks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text('SSN,total,note\n000554444,12345678,"write a.b@x.com, ""now"""\n\n000554445,1,\n')
    cells = files.delimited_cells(files.scan(spark, f"file://{tmp_path}/in"))
    out = f"file://{tmp_path}/out"
    sinks.write_files(sinks.delimited_files(tabular.redact_cells(tabular.with_headers(cells, "path"), resolve())), out).collect()
    assert (tmp_path / "out" / "t_redacted.csv").read_bytes().decode() == 'SSN,total,note\r\n█████████,12345678,"write █████████, ""now"""\r\n\r\n█████████,1,\r\n'
    assert sinks.verify_files(spark, out, "csv", resolve()).count() == 0
    assert {r.category for r in sinks.verify_files(spark, f"file://{tmp_path}/in", "csv", resolve()).collect()} == {"email", "ssn"}

    book = cells.where("col is not null").select(F.lit("b.xlsx").alias("path"), F.explode(F.array(F.lit("People a.b@x.com of a long title"), F.lit("x <&> 2"))).alias("sheet"), "row", (F.col("col") + 1).alias("col"), "text")
    done = tabular.redact_cells(tabular.with_headers(book, "path", "sheet"), resolve())
    sinks.write_files(sinks.workbook_files(done, resolve()), out).collect()
    read = {(r.unit, r.header): r.text for r in containers.units(files.scan(spark, out).where("name = 'b_redacted.xlsx'")).where("surface = 'cell'").collect()}
    assert read["x <&> 2!A2", "SSN"] == "█" * 9 and read["x <&> 2!C2", "note"] == 'write █████████, "now"' and read["People █████████ of a long title"[:31] + "!B2", "total"] == "12345678"
    assert sinks.verify_files(spark, out, "excel", resolve(), "%.xlsx").count() == 0
    sinks.write_files(sinks.workbook_files(book.withColumn("redacted", F.col("text")), resolve(categories="email")), f"file://{tmp_path}/raw").collect()
    assert {r.category for r in sinks.verify_files(spark, f"file://{tmp_path}/raw", "excel", resolve()).collect()} == {"email", "ssn"}


def test_sinks_need_a_reader():
    with pytest.raises(TypeError):
        sinks.register("blob", sinks.Sink(None, None))


def test_combined(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.txt", "mail a.b@x.com", 2), (1, "b.txt", "nothing", 1), (2, "c.txt", "4111 1111\n1111 1111", 1), (3, "d.txt", "fine", 1), (4, "e.txt", "SSN: 000", 1), (4, "f.txt", "55-4444 end", 1)], "group int, name string, text string, pages int")
    done = redact(rows, resolve())
    told = reports.native_report(done, verify(done, resolve(), "name"), "name").where("name <> 'd.txt'")
    outputs = done.select("group", "name", F.col("redacted").alias("text"), "pages")
    sinks.write_files(sinks.report_files(told, "name"), f"file://{tmp_path}").collect()
    assert "a.b@x.com" not in (tmp_path / "logs" / "a.txt_report.txt").read_text()
    written, report = sinks.combine(outputs, told, resolve(), f"file://{tmp_path}")
    # 2 has a failed report, 3 has none, and 4 holds a number only once its parts are together.
    assert {r.group: r.ok for r in report.collect()} == {1: True, 4: False}
    assert [r.name for r in written.collect()] == ["1_combined_redacted.txt"]
    assert (tmp_path / "1_combined_redacted.txt").read_text() == "mail █████████\fnothing"
    first = report.where("group = 1").first().report
    assert "1-2" in first and "PASS" in first and "*** FAIL" in report.where("group = 4").first().report


def test_pages_of_files(spark):
    def read(name, content):
        if name == "bad.pdf":
            raise ValueError("encrypted")
        return [("mail a.b@x.com and a.b@x.com", ["mailto:a.b@x.com"], False), ("", [], True), ("", [], True), ("SSN 000\n55-4444", [], True)]

    blobs = spark.createDataFrame([("x/a.pdf", "a.pdf", b"1"), ("x/bad.pdf", "bad.pdf", b"2")], "path string, name string, content binary")
    rows = pages.read_pages(blobs, read)
    assert [r.error for r in rows.where("error is not null").collect()] == ["ValueError: encrypted"]
    assert [r.error for r in pages.read_pages(blobs).collect()] == ["ValueError: no reader for this format"] * 2
    ocr = spark.createDataFrame([("x/a.pdf", 2, "ssn 000-55-4444", 0.9), ("x/a.pdf", 2, "zzz", 0.3), ("x/a.pdf", 1, "unused", 1.0)], "file_id string, page_no int, candidate string, confidence double")
    read_rows = pages.add_ocr(rows.where("error is null"), ocr)
    seen = spark.createDataFrame([("x/a.pdf", 4, "barcode"), ("x/a.pdf", 3, "face"), ("x/a.pdf", 3, "face")], "file_id string, page_no int, kind string")
    one = pages.summary(read_rows, resolve(), outside=seen).first()
    assert {c.category: c.n for c in one.counts} == {"email": 2, "link": 1, "ssn": 2, "barcode": 1, "face": 2}
    assert (one.page_count, one.scanned_pages, one.ocr_pages, one.image_pages, one.barcode_pages, one.vision_pages, one.faces, one.exit_code) == (4, [3], [2], [2, 3, 4], [4], [3], 2, 2)
    found = {m.matched: (m.places, m.located) for r in pages.locate(read_rows, resolve()).collect() for m in r.found}
    assert found["a.b@x.com"] == ([6, 20], True) and found["000-55-4444"] == ([5], True)
    text = reports.page_report(pages.summary(read_rows, resolve(), outside=seen), "file_id", "legal").first().report
    assert "NOTHING WAS REDACTED on pages 3" in text and "Codes were read" in text and "a.b@x.com" not in text and "PASS" in text
    left = spark.createDataFrame([("x/a.pdf", "ssn", 1)], "file_id string, category string, remaining long")
    failed = pages.summary(read_rows, resolve(), remaining=left)
    assert failed.first().exit_code == 3 and "*** FAIL" in reports.page_report(failed, "file_id").first().report


def test_places_with_loose_white_space(spark):
    rows = spark.createDataFrame([("4111 1111\n1111 1111 x", "4111 1111 1111 1111"), ("a.b a+b", "a+b"), ("q\\Ez q\\Ez", "q\\Ez"), ("abc", "z")], "t string, m string")
    assert [r.p for r in rows.select(pages.places(F.col("t"), F.col("m")).alias("p")).collect()] == [[1], [5], [1, 6], []]


def test_workbooks_are_written_and_read_in_pieces():
    """A book of many cells is never held as objects, on either side; one that breaks late gives its error alone."""
    n = 60_000
    tracemalloc.start()
    book = sinks.workbook([("a", ((i // 4 + 1, i % 4 + 1, f"t{i}") for i in range(n))), ("b", iter(()))])
    written, _ = tracemalloc.get_traced_memory()[1], tracemalloc.reset_peak()
    assert sum(1 for _ in containers.cells(book)) == n
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(written, read) < 8 << 20, (written, read)
    assert [(len(some), some[0][3]) for some in containers._chunks(lambda: containers.cells(book))] == [(10_000, f"t{i}") for i in range(0, n, 10_000)]

    def broken():
        yield from ((i,) for i in range(25_000))
        raise ValueError("late")

    with pytest.raises(ValueError):
        next(containers._chunks(broken))
