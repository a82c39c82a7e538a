"""Detection, replacement and verification against a matcher written with re."""

import re

import pytest
from pyspark.sql import functions as F

from inkveil.functions.catalogue import PATTERNS
from inkveil.functions import catalogue, checks, config, matcher, sql
from inkveil.functions.config import ConfigError, resolve
from inkveil.operators import batch, markup, tabular
from inkveil.operators.detect import counts, detect, distinct_counts, matches, outcomes, redact, verify
from inkveil.operators.reports import native_report
from inkveil.plans import queries

CASES = [
    "write a.b@example.com. or (555) 010-9999, SSN: 000-55-4444; balance $12,345.67",
    "SSN 000554444 EIN 12-3456789 Tax ID #123456789 Account #: 1234-567890 XXXX-1234 ref 12345678.",
    "card 4111-1111-1111-1111 and 3782-822463-10005 not 4111-1111-1111-1112; ABA 021000021, 021000021 000000000",
    "MRN: M123456 Patient ID 77-12 Member ID: ABC12345 Medicare No 1EG4-TE5-MK73 DL No D1234567 Passport No. X12345678",
    "DOB: 03/15/1980, Born March 5, 1979. 12 Maple Grove Ave, Apt 4B; Springfield, IL 62704-1234; P.O. Box 12",
    "Case No. 24-CV-00123 x１２３４５６７８９ 555 010 9999 call 555.010.9999.5 $12345678 1,12345678",
    "(555)\n010-9999 Account:\n12345678 4111 1111\n1111 1111  (555)  010-9999",
    "",
    "no digits here",
    None,
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def aba(s):
    d = [int(c) for c in s if c.isdigit()]
    n = sum(a * b for a, b in zip(d, (3, 7, 1) * 3, strict=False))
    return len(d) == 9 and n > 0 and n % 10 == 0


def plain(text, patterns=PATTERNS, exclude=()):
    out = {}
    squeezed = " ".join(text.split())
    for p in patterns:
        for src in dict.fromkeys((text, squeezed)):
            for m in re.finditer(p.body, src, re.I if p.any_case else 0):
                s = m[p.group].strip()
                ok = s and sum(c.isdigit() for c in s) >= p.digits and (p.check is None or {"luhn": luhn, "aba": aba}[p.check](s))
                if ok and not any(x in s.lower() for x in exclude):
                    out[p.category, s] = None
    return sorted(out, key=lambda x: -len(x[1]))


def replaced(text, found):
    hits = []
    for category, s in found:
        if n := text.count(s):
            hits.append((category, s, n, text[: text.index(s)].count("\n") + 1))
            text = text.replace(s, "█" * min(12, len(s)))
    return text, hits


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_same_as_re(spark):
    config = resolve()
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = CASES + docs
    got = redact(rows(spark, texts), config).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        want = plain(text) if text else []
        assert [tuple(m) for m in r.matches] == want, text
        if text is None:
            assert r.redacted is None
        else:
            assert (r.redacted, [tuple(h) for h in r.hits]) == replaced(text, want)


def test_overlap_leaves_a_fragment(spark):
    config = resolve({"custom_patterns": [{"regex": "AAAABBBB"}, {"regex": "BBBBCC"}]}, categories="email")
    assert redact(rows(spark, ["AAAABBBBCC"]), config).first().redacted == "████████CC"


def test_verdicts(spark):
    config = resolve()
    texts = ["(555)\n010-9999", "4111 1111\n1111 1111", "mail a@b.com", "", None]
    codes = {r.doc_id: r.exit_code for r in outcomes(rows(spark, texts), config, "doc_id").collect()}
    assert codes == {0: 0, 1: 3, 2: 0, 3: 2, 4: 2}
    assert [r.doc_id for r in verify(redact(rows(spark, texts), config), config, "doc_id").collect()] == [1]


def test_config():
    assert resolve(preset="medical").categories[0] == "email"
    c = resolve({"preset": "legal", "categories": {"tax_id": True, "phone": False}, "custom_terms": {"names": ["Casey Plantedname", "x"]}, "odd": 1, "custom_patterns": [{"regex": "("}]})
    assert "tax_id" in c.categories and "phone" not in c.categories and "custom" in c.categories and len(c.warnings) == 3
    for bad in ({"preset": "no"}, {"categories": {"no": True}}, {"custom_terms": ["x"]}):
        with pytest.raises(ConfigError):
            resolve(bad)
    with pytest.raises(ConfigError):
        resolve({}, categories="email,no")


def test_terms_and_exclusions(spark):
    c = resolve({"custom_terms": ["Jane Smith"], "exclude_terms": ["help"]}, categories="email")
    got = detect(rows(spark, ["JANE  smith and Janet Smith", "help@x.com me@x.com"]), c).orderBy("doc_id").collect()
    assert [m.matched for m in got[0].matches] == ["JANE  smith", "JANE smith"]
    assert [m.matched for m in got[1].matches] == ["me@x.com"]


def test_cells(spark):
    cells = spark.createDataFrame([("f", 1, 0, "ssn"), ("f", 2, 0, "000554444"), ("f", 1, 1, "total"), ("f", 2, 1, "12345678"), ("f", 3, 2, None)], "path string, row int, col int, text string")
    for give in (tabular.with_headers, tabular.headers_by_window):
        got = {(r.row, r.col): r.redacted for r in tabular.redact_cells(give(cells, "path"), resolve()).collect()}
        assert got == {(1, 0): "ssn", (2, 0): "█" * 9, (1, 1): "total", (2, 1): "12345678", (3, 2): None}


def test_pages(spark):
    page = """<a href='mailto:a.b@x.com'>a.b&#64;x.com</a> a.b%40x.com <SCRIPT>x</script>"""
    r = markup.redact_pages(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"), resolve()).orderBy("page_id").collect()
    assert "x.com" not in r[0].redacted and r[0].hits[0].n == 3 and r[1].redacted is None
    links = spark.createDataFrame([("mailto:a@b.com",), ("http://x.org",)], "uri string")
    assert [x.drop for x in markup.link_hits(links, resolve()).collect()] == [True, False]


def test_batch(spark):
    parts = spark.createDataFrame([("a", 0), ("a", 4), ("b", 2), ("b", 3)], "f string, exit_code int")
    assert dict(map(tuple, batch.worst(parts, "f").collect())) == {"a": 4, "b": 3}
    assert batch.worst(spark.createDataFrame([("a", 5), ("a", 3), ("b", 5), ("b", 4)], "f string, exit_code int"), "f").orderBy("f").collect() == [("a", 3), ("b", 5)]
    done = redact(rows(spark, ["mail a@b.com", "4111 1111\n1111 1111"]), resolve())
    facts = spark.createDataFrame([(0, 1, ["not UTF-8; read as latin-1"], None), (7, 0, [], "too many attachments")], "doc_id long, unit_count long, notes array<string>, skipped string")
    reports = {r.doc_id: r.report for r in native_report(done, verify(done, resolve(), "doc_id"), "doc_id", "legal", facts=facts).collect()}
    assert "a@b.com" not in reports[0] and "PASS" in reports[0] and "*** FAIL" in reports[1]
    assert "read as latin-1" in reports[0] and "Scanned : 1 line(s)" in reports[0] and "skipped: too many" in reports[7] and "Signatures are images" in reports[1]
    assert "a@b.com" in native_report(done, verify(done, resolve(), "doc_id"), "doc_id", dry_run=True).where("doc_id = 0").first().report
    reports = {k: r for k, r in reports.items() if k < 7}
    blocked = batch.gate(done.select("doc_id"), spark.createDataFrame(list(reports.items()), "doc_id long, report string"), "doc_id")
    assert [r.doc_id for r in blocked.collect()] == [1]
    many = spark.createDataFrame([(1, [("n", bytearray(b"x"), None)] * 52)], "id int, attachments array<struct<name:string,blob:binary,skip:string>>")
    assert batch.attachments(many, "id").where(F.col("skip").isNull()).count() == 50


def test_settings(spark, tmp_path):
    warned = resolve({"custom_term": ["x"], "options": {"oct": True, "output": {"image": "pdf"}}}).warnings
    assert warned == ("unknown setting: custom_term", "unknown option: oct", "unknown output setting: image")
    assert config.terms({"a": ["x ", {"b": "y"}], "c": None, "d": ["", 7]}) == ["x", "y", "7"]
    (tmp_path / "config").mkdir()
    (tmp_path / config.DEFAULT).write_text("preset: legal\npasswords: {a.pdf: secret}\ncategories: {tax_id: true, phone: false}\n")
    cfg = config.load(root=str(tmp_path))
    assert cfg["preset"] == "legal" and config.load(root="/nowhere") == {} and config.load(config.DEFAULT, str(tmp_path)) == cfg
    with pytest.raises(ConfigError):
        config.load("none.yaml", str(tmp_path))
    told = {tuple(r) for r in config.check(spark, cfg).collect()}
    assert {("preset", "legal"), ("always on", "tax_id"), ("never", "phone"), ("passwords", "1")} <= told and not any("secret" in v for _, v in told)
    assert config.password(resolve(cfg), "a.pdf") == "secret" and config.password(resolve(cfg), "a.pdf", "own") == "own" and config.password(resolve(cfg), "b.pdf") is None
    assert config.listing(spark).count() == len(resolve().categories)
    assert config.converter(".docx") == "own" and config.converter(".odp", office="/usr/bin/soffice") == "/usr/bin/soffice" and config.converter(".docx", {"office_converter": "simple"}, "/usr/bin/soffice") == "own"
    for extension, options in ((".odp", {}), (".docx", {"office_converter": "libreoffice"}), (".docx", {"office_converter": "msoffice"}), (".docx", {"office_converter": "x"})):
        with pytest.raises(ConfigError):
            config.converter(extension, options)


def test_own_validator(spark):
    checks.validator("even", lambda x: x.cast("int") % 2 == 0)
    p = catalogue.Pattern("even", "custom", r"\b\d{3}\b", check="even")
    assert [m.matched for m in detect(rows(spark, ["123 124"]), config.Config("general", (p,))).first().matches] == ["124"]
    with pytest.raises(ValueError):
        checks.validator("luhn", lambda x: x)


def test_sql_functions_find_the_same(spark):
    sql.register(spark)
    rows(spark, CASES).createOrReplaceTempView("cases")
    want = {r.doc_id: [tuple(m) for m in r.matches] for r in detect(rows(spark, CASES), resolve()).collect()}
    got = {r.doc_id: [tuple(m) for m in r.m] for r in spark.sql("select doc_id, pii_matches(text) as m from cases").collect()}
    assert got == want and all(matcher.find(t, resolve()) == want[i] for i, t in enumerate(CASES))
    flat = spark.sql("select doc_id, category, matched from cases, lateral detect_pii(text)").collect()
    assert sorted(map(tuple, flat)) == sorted((i, *m) for i, ms in want.items() for m in ms)


def test_signs_and_folded_letters(spark):
    texts = ["ſſn 000554444", "SOC. SEC. No: 000-55-4444", "meMBer id ab1234", "ſoc ſec 000554444", "P.O. BOX 12"]
    for text, r in zip(texts, detect(rows(spark, texts), resolve()).orderBy("doc_id").collect(), strict=True):
        assert [tuple(m) for m in r.matches] == plain(text), text


def test_small_functions(spark):
    text = "The quick brown fox  jumps over averyveryverylongword and\nrests"
    got = spark.createDataFrame([(text, b"caf\xe9", "a/b" * 20, "x" * 40)], "t string, b binary, s string, l string").select(checks.wrap(F.col("t"), 12), checks.decode_note(F.col("b")), checks.sheet_title(F.col("s"), F.lit(3)), checks.sheet_title(F.col("l"), F.lit(1)), checks.latin1_losses(F.lit("a█☃é"))).first()
    assert tuple(got) == (["The quick", "brown fox", "jumps over", "averyveryverylongword", "and rests"], "not UTF-8; read as latin-1", "Sheet_3", "x" * 31, 2)


def test_spellings():
    import html
    import urllib.parse

    for s in ("a&b", "it's", '"q"', "é☃", "<x>", "a.b@c"):
        ways = [s, html.escape(s), urllib.parse.quote(s), urllib.parse.quote(s).lower(), "".join(f"&#{ord(c)};" for c in s), "".join(f"&#x{ord(c):04X};" for c in s), s.encode("ascii", "xmlcharrefreplace").decode()]
        assert all(re.fullmatch(markup.any_encoding(s), w) for w in ways), (s, markup.any_encoding(s))
        assert not re.fullmatch(markup.any_encoding(s), s + "x")


def test_pages_are_verified_in_all_spellings(spark):
    pages = spark.createDataFrame([(1, "<a href='mailto:a.b@x.com'>x</a> a.b&#64;x.com"), (2, "c%40y.org")], "page_id int, html string")
    done = markup.redact_pages(pages, resolve())
    assert markup.verify_pages(done, resolve(), "page_id").count() == 0
    assert markup.verify_pages(pages.withColumn("redacted", F.col("html")), resolve(), "page_id").count() == 2


def test_pages_come_in_short_batches(spark):
    """A worker holds a batch of pages in all its variants, so its memory must not grow with the rows of a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    markup.redact_pages(spark.createDataFrame([(1, "x")], "page_id int, html string"), resolve())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_each_text_is_scanned_once(spark):
    """What is told of matches must not make Spark scan a text once more for a filter on whether it has any."""
    texts = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail a@b.com "), F.col("id").cast("string")).alias("text"))
    done, scans = redact(texts, resolve()), lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(f", {PATTERNS[0].java},")
    assert scans(detect(texts, resolve())) == scans(counts(done)) == scans(distinct_counts(done, "doc_id")) == 1
    assert scans(verify(done, resolve(), "doc_id")) == 2
    told = queries.queries()["reports_written_and_read"](spark, "/root/testdata/sf0.001")
    assert scans(told) == 2 and told._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    # The matches are few bytes, but each file's report is work.
    assert "REPARTITION_BY_NUM" in told._jdf.queryExecution().executedPlan().toString()


def test_reports_in_one_pass(spark):
    """Files of several units, without a key, without text, and with matches that only their output has."""
    units = spark.createDataFrame([("a", "mail a@b.com a@b.com"), ("a", "x\na@b.com, 000-55-4444"), ("a", None), ("b", "4111 1111\n1111 1111"), ("b", "4111 1111\n1111 1111 call 555-010-9999"), ("c", None), ("d", "nothing"), (None, "me@x.com")], "name string, text string")
    done = redact(units, resolve()).withColumn("hits", F.when(F.col("text").isNotNull(), F.col("hits")))
    again = done.withColumn("remaining", matches(F.col("redacted"), resolve()))
    for dry in (False, True):
        told = {r.name: r.report for r in native_report(again, None, "name", dry_run=dry).collect()}
        assert told == {r.name: r.report for r in native_report(done, verify(done, resolve(), "name"), "name", dry_run=dry).collect()}
        assert told.keys() == {"a", "b", "c", "d", None} and ("*** FAIL" in told["b"]) != dry
    told = {r.name: r.report.split("\n") for r in native_report(again, None, "name").collect()}
    assert f"  {'Email addresses':<32} {3:>4} match(es)" in told["a"] and f"  {'Social Security numbers':<32} {1:>4} match(es)" in told["a"]
    assert [x.split()[0] for x in told["a"] if re.match(r"  \d+ {2,}\S", x)] == ["1", "2", "2"]
    assert "    Credit/debit card numbers: 2" in told["b"] and not any("match(es)" in x for k in ("c", "d", None) for x in told[k])
