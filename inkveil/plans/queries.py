"""Queries over the driver's tables, each with the SQL of its oracle where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalogue import PATTERNS, PRESETS
from ..functions.checks import latin1, latin1_losses, mask, sheet_title
from ..functions.config import Config, resolve
from ..operators import batch, markup, pages, reports, tabular
from ..operators.detect import counts, dealt, detect, distinct_counts, exploded, hits, matches, outcomes, redact, verify
from ..sinks import files as sinks
from ..sources import containers, files
from .oracle import PRESET_ROWS, found, replaced, scanned, stands

Query = Callable[[SparkSession, str], DataFrame]
BY_KEY = {p.key: p for p in PATTERNS}

#: Text with a value for each detector, written the same in both dialects. n is the customer's number.
SYNTHETIC = {
    "ssn": "concat('id ', substr(lpad(cast(n as varchar(20)), 9, '0'), 1, 3), '-', substr(lpad(cast(n as varchar(20)), 9, '0'), 4, 2), '-', substr(lpad(cast(n as varchar(20)), 9, '0'), 6, 4), ' end')",
    "ssn_labelled": "concat('SSN: ', lpad(cast(n as varchar(20)), 9, '0'), ', Balance: $1,863.84')",
    "ein": "concat('firm ', lpad(cast(n % 90 + 10 as varchar(20)), 2, '0'), '-', lpad(cast(n as varchar(20)), 7, '0'), ' pays')",
    "tax_labelled": "concat('Taxpayer ID #', lpad(cast(n as varchar(20)), 9, '0'), ' on file')",
    "account_labelled": "concat('Account #: A-', lpad(cast(n as varchar(20)), 8, '0'), ' of $12,345.67')",
    "account_masked": "concat('card XXXX-', lpad(cast(n % 10000 as varchar(20)), 4, '0'), ' and ****', lpad(cast(n as varchar(20)), 6, '0'))",
    "account_bare": "concat('ref ', lpad(cast(n as varchar(20)), 10, '7'), ' costs $12345678.')",
    "card_16": "concat('paid 4111-1111-1111-', lpad(cast(n as varchar(20)), 4, '0'), ' today')",
    "card_15": "concat('paid 3782 822463 1', lpad(cast(n as varchar(20)), 4, '0'), ' today')",
    "routing_labelled": "concat('ABA no: ', lpad(cast(n as varchar(20)), 9, '0'))",
    "routing_bare": "concat('via ', lpad(cast(n as varchar(20)), 9, '0'), ' wire')",
    "mrn": "concat('MRN: M', lpad(cast(n as varchar(20)), 6, '0'), ' seen')",
    "insurance": "concat('Member ID: ABC', lpad(cast(n as varchar(20)), 5, '0'))",
    "insurance_public": "concat('Medicare No ', lpad(cast(n as varchar(20)), 9, '1'), 'A')",
    "licence": "concat('Driver''s License: D', lpad(cast(n as varchar(20)), 7, '0'))",
    "passport": "concat('Passport No. X', lpad(cast(n as varchar(20)), 8, '0'))",
    "dob": "concat('DOB: ', cast(n % 12 + 1 as varchar(20)), '/', cast(n % 28 + 1 as varchar(20)), '/1980; Born March ', cast(n % 28 + 1 as varchar(20)), ', 1979')",
    "street": "concat('lives at ', cast(n as varchar(20)), ' Maple Grove Ave, Apt ', cast(n % 9 as varchar(20)), 'B now')",
    "city": "concat('in Springfield, IL ', lpad(cast(n as varchar(20)), 5, '6'), ' or so')",
    "po_box": "concat('to P.O. Box ', cast(n as varchar(20)), ' please')",
    "case": "concat('Case No. 24-CV-', lpad(cast(n as varchar(20)), 5, '0'))",
    "email": "concat('write user', cast(n as varchar(20)), '@example.com.')",
}


#: Near misses: the same shapes with a digit too few, a wrong checksum or another label. No detector of the key finds them.
MISSES = {
    "ssn": "concat('id 123-456-', lpad(cast(n as varchar(20)), 7, '0'), ' end')",
    "ssn_labelled": "concat('SSN: ', substr(lpad(cast(n as varchar(20)), 9, '0'), 1, 8), ' and no more')",
    "ein": "concat('firm 1-', lpad(cast(n as varchar(20)), 7, '0'), ' pays')",
    "tax_labelled": "concat('Taxpayer #', lpad(cast(n as varchar(20)), 9, '0'))",
    "account_labelled": "concat('Accounts: ', cast(n % 1000 as varchar(20)), ' open')",
    "account_masked": "concat('card X-', lpad(cast(n % 10000 as varchar(20)), 4, '0'))",
    "account_bare": "concat('costs $', lpad(cast(n as varchar(20)), 10, '7'), ' or 1.', lpad(cast(n as varchar(20)), 9, '3'))",
    "card_16": "concat('paid 4111-1111-1111-', cast(n % 9 as varchar(20)), '111 or 4111 1111 1111 111')",
    "card_15": "concat('paid 3782 822463 ', lpad(cast(n % 1000 as varchar(20)), 4, '0'))",
    "routing_labelled": "concat('ABA no: ', substr(lpad(cast(n as varchar(20)), 9, '0'), 1, 8), ' here')",
    "routing_bare": "concat('via ', lpad(cast(n as varchar(20)), 8, '0'), ' or 000000000 wire')",
    "mrn": "concat('MRN: see page ', cast(n as varchar(20)))",
    "insurance": "concat('Member since ', cast(1990 + n % 30 as varchar(20)))",
    "insurance_public": "concat('Medicare pays ', cast(n % 100 as varchar(20)), ' percent')",
    "licence": "concat('Driver of bus ', cast(n as varchar(20)))",
    "passport": "concat('Passport photos: ', cast(n % 90 as varchar(20)))",
    "dob": "concat('Borne on ', cast(n % 28 + 1 as varchar(20)), '/1/1980')",
    "street": "concat('item ', cast(n as varchar(20)), ' maple grove avenue')",
    "city": "concat('in springfield, IL ', lpad(cast(n as varchar(20)), 5, '6'))",
    "po_box": "concat('to Box ', cast(n as varchar(20)))",
    "case": "concat('in case 24-CV-', lpad(cast(n as varchar(20)), 5, '0'))",
    "email": "concat('write user', cast(n as varchar(20)), '@example or @example.com')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer").select(*columns))


def said(key: str) -> str:
    """SQL of a customer's text for a detector: a near miss for every third."""
    return f"case when n % 3 = 0 then {MISSES[key]} else {SYNTHETIC[key]} end"


def _synthetic(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return customers(spark, sf_dir, "c_custkey").select(F.col("c_custkey").alias("n")).select("n", F.expr(said(key)).alias("text"))


def _detector(key: str) -> Query:
    """Matches of one detector: n, matched."""
    return lambda spark, d: exploded(_synthetic(spark, d, key), "n", matched=hits(F.col("text"), BY_KEY[key]))


def _detector_sql(key: str) -> str:
    return f"WITH s AS (SELECT c_custkey AS n FROM customer), t AS (SELECT n, {said(key)} AS text FROM s), m AS (SELECT n, trim(unnest({found(key, 'text')})) AS matched FROM t) SELECT n, matched FROM m WHERE {stands(key)}"


_ALL = resolve()


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def detect_counts_documents(spark: SparkSession, d: str) -> DataFrame:
    """Distinct matches of all detectors over free text, by category."""
    return distinct_counts(detect(documents(spark, d), _ALL)).select("category", "n")


def detect_all_documents(spark: SparkSession, d: str) -> DataFrame:
    """All 23 detectors over free text, each match once a document."""
    return exploded(detect(documents(spark, d), _ALL), "doc_id", m="matches").select("doc_id", "m.category", "m.matched")


def email_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.size(hits(F.col("text"), BY_KEY["email"])).alias("n"))
    return docs.groupBy("lang").agg(F.sum("n").cast("long").alias("n_emails"), F.count_if(F.col("n") > 0).alias("n_docs"))


def phone_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a phone number, and the first."""
    found = hits(F.col("text"), BY_KEY["phone"])
    return documents(spark, d).select("doc_id", F.get(found, F.lit(0)).alias("first_phone")).where("first_phone is not null")


def account_bare_pages(spark: SparkSession, d: str) -> DataFrame:
    return exploded(table(spark, d, "pages"), "page_id", matched=hits(F.col("html"), BY_KEY["account_bare"]))


def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    done = redact(documents(spark, d), _ALL)
    return done.select("doc_id", F.md5("redacted").alias("redacted_md5"), F.length("redacted").cast("long").alias("n_chars"), F.size("hits").cast("long").alias("n_hits"))


def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences replaced, by category, and rows of the batch's totals: n, categories that had any, characters read."""
    return counts(redact(documents(spark, d), _ALL)).select("category", F.col("n").cast("long").alias("n"))


def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: units, matches replaced, categories that had any, characters of text, lines."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    done = redact(docs, _ALL)
    by = counts(done, "source").groupBy("source").agg(F.sum("n").cast("long").alias("total"), F.count(F.lit(1)).alias("n_categories"))
    read = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).cast("long").alias("n_chars"))
    return read.join(by, read["source"].eqNullSafe(by["source"]), "left").select(read["source"], "n_units", "n_chars", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_categories", F.lit(0)).alias("n_categories"))


def verify_documents(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents re-scanned, and those with anything left."""
    done = redact(documents(spark, d), _ALL)
    left = F.size(matches(F.col("redacted"), _ALL))
    return done.select(left.alias("n")).agg(F.count(F.lit(1)).alias("n_scanned"), F.count_if(F.col("n") > 0).alias("n_failed"))


def verify_remaining(spark: SparkSession, d: str) -> DataFrame:
    return verify(redact(documents(spark, d), _ALL), _ALL, "doc_id")


def outcomes_documents(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(documents(spark, d), _ALL, "doc_id")


def mask_report(spark: SparkSession, d: str) -> DataFrame:
    found = exploded(documents(spark, d), "doc_id", m=hits(F.col("text"), BY_KEY["email"]))
    return found.select("doc_id", mask(F.col("m")).alias("masked"))


def header_context_scan(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that only a column's header makes account numbers; the name column is left alone in tables."""
    cust = customers(spark, d, "c_custkey", "c_name").select("c_custkey", F.col("c_name").alias("Name"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("SSN"))
    cells = tabular.melt(cust, "c_custkey", ["Name", "SSN"])
    return exploded(tabular.redact_cells(cells, resolve({}, categories="ssn,account_number")), "row", "header", h="hits").select("row", "header", "h.category", "h.matched")


def tabular_vs_text_counts(spark: SparkSession, d: str) -> DataFrame:
    base = resolve({}, categories="account_number")
    rows = customers(spark, d, "c_name").select(F.col("c_name").alias("text"))
    one = rows.select(F.size(matches(F.col("text"), base)).alias("t"), F.size(matches(F.col("text"), base.tabular())).alias("c"))
    return one.agg(F.sum("t").cast("long").alias("n_text"), F.sum("c").cast("long").alias("n_tabular"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages without scripts, styles and tags, entities decoded."""
    markup.small_batches(spark)
    return table(spark, d, "pages").select("page_id", F.md5(markup.to_text(F.col("html"))).alias("text_md5"))


def attr_targets(spark: SparkSession, d: str) -> DataFrame:
    return exploded(table(spark, d, "pages"), "page_id", target=markup.attributes(F.col("html")))


def redact_html_pages(spark: SparkSession, d: str) -> DataFrame:
    done = markup.redact_pages(table(spark, d, "pages").select("page_id", "html"), resolve())
    return done.select("page_id", "redacted", F.size("hits").alias("n_hits"))


def custom_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a whole-word custom term, whatever its case."""
    config = resolve({"custom_terms": ["license", "apache license"]}, categories="email")
    only = Config("general", tuple(p for p in config.patterns if p.category == "custom"))
    return detect(documents(spark, d), only).where(F.size("matches") > 0).select("doc_id")


def exclude_terms(spark: SparkSession, d: str) -> DataFrame:
    config = Config("general", (BY_KEY["email"],), ("mail1",))
    return exploded(detect(documents(spark, d), config), "doc_id", m="matches").select("doc_id", "m.matched")


def preset_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each preset over one synthetic text a customer that holds a value of every kind."""
    text = F.expr(f"concat_ws(' | ', {', '.join(SYNTHETIC[k] for k in _PRESET_KEYS)})")
    rows = customers(spark, d, "c_custkey").select(F.col("c_custkey").alias("n")).select(text.alias("text"))
    config = Config("general", tuple(BY_KEY[k] for k in _PRESET_KEYS))
    by = exploded(rows, m=matches(F.col("text"), config)).groupBy(F.col("m.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    sets = spark.createDataFrame([(p, c) for p, cs in PRESETS.items() for c in cs], "preset string, category string")
    return sets.join(by, "category").select("preset", "category", "n")


_PRESET_KEYS = tuple(SYNTHETIC)


def exit_code_severity(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "events").select("user_id", F.element_at(F.array(*[F.lit(x) for x in (0, 4, 2, 3)]), (F.col("event_id") % 4 + 1).cast("int")).alias("exit_code"))
    return batch.worst(parts, "user_id")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).otherwise(0).alias("exit_code")).distinct()


def batch_buckets(spark: SparkSession, d: str) -> DataFrame:
    return batch.buckets(_outcomes(spark, d))


def batch_names(spark: SparkSession, d: str) -> DataFrame:
    return batch.names(_outcomes(spark, d), "name")


def _folder(spark: SparkSession, name: str) -> str:
    """An empty folder that executors share, for files that a query writes and reads again."""
    top = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{top}/inkveil-files/{name}-{uuid.uuid4().hex}"


def _customer_cells(spark: SparkSession, d: str) -> DataFrame:
    """A table for each nation: a header, and a line for each customer: key, name, number and address."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("ssn"), F.expr("case when c_custkey % 5 = 0 then 'write user@example.com, \"now\"' else c_mktsegment end").alias("note"))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) + 1)
    cells = F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("text")) for i, c in enumerate(("c_custkey", "c_name", "ssn", "note"))))
    body = rows.select("c_nationkey", "row", F.explode(cells).alias("c")).select("c_nationkey", "row", "c.col", "c.text")
    heads = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(h).alias("text")) for i, h in enumerate(("Key", "Name", "SSN", "Note"))))
    heads = rows.select("c_nationkey").distinct().select("c_nationkey", F.lit(1).alias("row"), F.explode(heads).alias("c")).select("c_nationkey", "row", "c.col", "c.text")
    return heads.union(body).withColumn("path", F.concat(F.lit("in/nation"), F.col("c_nationkey").cast("string"), F.lit(".csv")))


def csv_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Redacted tables, a file a nation, written and read again: file, row, col, text."""
    done = tabular.redact_cells(tabular.with_headers(_customer_cells(spark, d), "path"), _ALL).withColumn("error", F.lit(None).cast("string"))
    folder = _folder(spark, "csv")
    sinks.write_files(sinks.delimited_files(done), folder).count()
    cells = files.delimited_cells(files.scan(spark, folder))
    return cells.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "row", "col", "text")


def workbooks_written_and_verified(spark: SparkSession, d: str) -> DataFrame:
    """The same as workbooks: cells read again by file, and what the sink's own reader still finds in them."""
    cells = _customer_cells(spark, d).withColumn("path", F.regexp_replace("path", "csv$", "xlsx")).withColumn("sheet", F.lit("customers"))
    done = tabular.redact_cells(tabular.with_headers(cells, "path"), _ALL).withColumn("col", F.col("col") + 1)
    folder = _folder(spark, "xlsx")
    sinks.write_files(sinks.workbook_files(done, _ALL), folder).count()
    name = F.regexp_extract("path", r"([^/]*)$", 1).alias("file")
    read = containers.workbook_cells(files.scan(spark, folder)).select(name, "text")
    left = sinks.verify_files(spark, folder, "excel", _ALL).select(name, "remaining").groupBy("file").agg(F.sum("remaining").cast("long").alias("remaining"))
    read = read.groupBy("file").agg(F.count("text").alias("n_cells"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.count_if(F.contains("text", F.lit("█"))).alias("n_redacted"))
    return read.join(left, "file", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))


def reports_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    """A report for each document, and what it says: whether it failed, matches by category, lines of detail."""
    done = redact(documents(spark, d), _ALL).select(F.col("doc_id").cast("string").alias("doc_id"), "hits", matches(F.col("redacted"), _ALL).alias("remaining"))
    told = reports.native_report(done, None, "doc_id")
    total = F.aggregate(F.regexp_extract_all("report", F.lit(r"(\d+) match\(es\)"), F.lit(1)), F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))
    return told.select(F.col("doc_id").cast("long").alias("doc_id"), F.contains("report", F.lit(reports.FAIL)).alias("failed"), total.alias("total"), F.regexp_count("report", F.lit(r"(?m)^  \d+ {2,}\S")).cast("long").alias("n_details"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as files, turns as pages; every fourth has an image, and every eighth no text layer but what OCR reads."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "role", "text", ((F.col("turn") + F.col("conv_id")) % 8).alias("k"))
    text = F.concat_ws(" ", F.col("text"), F.concat(F.lit("case no "), F.col("file_id").cast("string"), F.lit("-2024 a@b.org a@b.org")))
    return turns.select("file_id", "page_no", F.when(F.col("k") == 0, F.lit("")).otherwise(text).alias("text"), F.array(F.lit("mailto:x@y.org"), F.lit("http://y.org")).alias("links"), F.col("k").isin(0, 4).alias("has_images"), "role")


def _read_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d)
    found = rows.where("text = ''").select("file_id", "page_no", F.explode(F.array(F.struct(F.concat(F.lit("ssn 000-55-"), F.lpad(F.col("page_no").cast("string"), 4, "0")).alias("candidate"), F.lit(0.9).alias("confidence")), F.struct(F.lit("??").alias("candidate"), F.lit(0.4).alias("confidence")))).alias("c")).select("file_id", "page_no", "c.*").where("page_no % 2 = 1 or confidence < 0.5")
    return pages.add_ocr(rows, found.where("page_no % 3 > 0"))


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of pages by category: as many as they have places, links apart."""
    rows = _read_pages(spark, d)
    return pages.page_counts(pages.locate(rows, _ALL)).unionByName(pages.link_counts(rows, _ALL))


def page_sets(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each file that are scanned, read by OCR, with images, and with no code found."""
    rows = _read_pages(spark, d)
    codes = rows.where("has_images and page_no % 2 = 0").select("file_id", "page_no", F.lit("barcode").alias("kind"))
    out = pages.page_sets(rows, "file_id", codes)
    text = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",").alias(c)
    flagged = batch.flagged_pages(F.col("image_pages"), F.col("barcode_pages"))
    code = pages.exit_code(F.lit(0), F.col("scanned_pages"), F.col("total_text_chars"))
    return out.select("file_id", "page_count", text("scanned_pages"), text("ocr_pages"), text("image_pages"), F.array_join(F.transform(flagged, lambda p: p.cast("string")), ",").alias("flagged_pages"), code.alias("exit_code"))


def match_places(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses of documents with their first place and how many places they have."""
    rows = documents(spark, d).withColumn("page_text", F.coalesce("text", F.lit("")))
    found = exploded(pages.locate(rows, Config("general", (BY_KEY["email"],))), "doc_id", m="found")
    return found.select("doc_id", "m.matched", F.get("m.places", F.lit(0)).alias("first_place"), F.size("m.places").cast("long").alias("n_places"))


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Of each user the event of the highest id, as the most certain reading."""
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("candidate"), F.col("event_id").alias("confidence"))
    return pages.best_candidate(rows, "user_id")


def sheet_titles(spark: SparkSession, d: str) -> DataFrame:
    """Names as sheet titles, redacted and cut, and characters that latin-1 loses."""
    name = F.concat(F.col("p_name"), F.lit("█ of a long title"))
    return table(spark, d, "part").select("p_partkey", sheet_title(name, F.col("p_partkey")).alias("title"), latin1_losses(name).cast("long").alias("n_lost"))


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("pages"))
    return batch.page_ranges(files, "conv_id", "role", "pages").select("conv_id", "role", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"), "label")


def combine_gate(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "*** FAIL").otherwise("PASS").alias("report")).distinct()
    return batch.gate(table(spark, d, "documents").select("doc_id"), reports, "doc_id")


def header_join(spark: SparkSession, d: str) -> DataFrame:
    """Cells of files of five rows with the text of their column's first row."""
    cells = table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).cast("int").alias("row"), F.lit(0).alias("col"), F.col("role").alias("text"))
    return tabular.with_headers(cells, "file_id").select("file_id", "row", "text", "header")


def header_window(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).cast("int").alias("row"), F.lit(0).alias("col"), F.col("role").alias("text"))
    return tabular.headers_by_window(cells, "file_id").select("file_id", "row", "text", "header")


def spine_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Spine items joined with a manifest that lacks some, in order."""
    spine = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("idref"))
    spine = spine.withColumn("ord", F.row_number().over(Window.partitionBy("book").orderBy("idref")))
    manifest = table(spark, d, "lineitem").where("l_linenumber = 1 and l_returnflag <> 'R'").select(F.col("l_orderkey").alias("idref"), F.concat(F.lit("c"), F.col("l_partkey").cast("string"), F.lit(".xhtml")).alias("href")).distinct()
    return spine.join(manifest, "idref").select("book", "ord", "href")


def sanitise_latin1(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(latin1(F.concat(F.lit("█\t"), F.col("text")))).alias("clean_md5"))


def _named(*fs) -> dict[str, Query]:
    return {f.__name__: f for f in fs}


def queries() -> dict[str, Query]:
    return {f"detector_{k}": _detector(k) for k in SYNTHETIC} | _named(
        detect_counts_documents, detect_all_documents, email_by_lang, phone_docs, account_bare_pages, redact_documents, redaction_counts, batch_totals, verify_documents, verify_remaining, outcomes_documents, mask_report, header_context_scan, tabular_vs_text_counts, html_to_text, attr_targets, redact_html_pages, custom_terms, exclude_terms, preset_counts,
        exit_code_severity, batch_buckets, batch_names, page_ranges, combine_gate, header_join, header_window, spine_manifest, sanitise_latin1, csv_written_and_read, workbooks_written_and_verified, reports_written_and_read, page_counts, page_sets, match_places, best_candidate, sheet_titles,
    )


def oracle_sql() -> dict[str, str]:
    email = found("email", "text")
    cells = "SELECT conv_id AS file_id, (turn + 1)::INT AS row, role AS text FROM conversations"
    header = f"WITH c AS ({cells}), h AS (SELECT file_id, text AS header FROM c WHERE row = 1) SELECT c.file_id, c.row, c.text, CASE WHEN c.row > 1 THEN h.header END AS header FROM c LEFT JOIN h USING (file_id)"
    docs = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
    done = f"WITH {docs}, {replaced('d', 'doc_id', 'text')}"
    again = f"{done}, {scanned('r', 'doc_id', 'redacted', name='left_over')}"
    hit = "unnest(string_split(rtrim(hits, ';'), ';')) AS h"
    outcome = "SELECT CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 ELSE 0 END AS exit_code, 'file' || doc_id::VARCHAR AS name FROM labels"
    customers = "c AS (SELECT c_nationkey AS k, c_custkey, c_name, lpad(c_custkey::VARCHAR, 9, '0') AS matched, CASE WHEN c_custkey % 5 = 0 THEN 'write user@example.com, \"now\"' ELSE c_mktsegment END AS note, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1)::INT AS row FROM customer)"
    written = f"""{customers}, body AS (SELECT k, row, unnest([0, 1, 2, 3]) AS col, unnest([c_custkey::VARCHAR, CASE WHEN {stands('routing_bare')} THEN replace(c_name, matched, repeat('█', 9)) ELSE c_name END, repeat('█', 9), replace(note, 'user@example.com', repeat('█', 12))]) AS text FROM c
      UNION ALL SELECT k, 1, unnest([0, 1, 2, 3]), unnest(['Key', 'Name', 'SSN', 'Note']) FROM (SELECT DISTINCT k FROM c))"""
    turns = """p AS (SELECT conv_id AS file_id, (turn + 1)::INT AS page_no, (turn + conv_id) % 8 AS k, concat_ws(' ', text, 'case no ' || conv_id::VARCHAR || '-2024 a@b.org a@b.org') AS own FROM conversations),
      q AS (SELECT file_id, page_no, k, k IN (0, 4) AS has_images, k = 0 AND page_no % 3 > 0 AS ocr, CASE WHEN k > 0 THEN own WHEN page_no % 3 > 0 THEN CASE WHEN page_no % 2 = 1 THEN 'ssn 000-55-' || lpad(page_no::VARCHAR, 4, '0') ELSE '??' END ELSE '' END AS text, row_number() OVER () AS i FROM p)"""
    count_of = "SELECT i, category, sum(greatest((length(text) - length(replace(text, matched, ''))) // length(matched), 1))::BIGINT AS n FROM m JOIN q USING (i) GROUP BY ALL"
    joined = lambda what, name: f"coalesce(string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER ({what}), '') AS {name}"
    text_of = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    return {f"detector_{k}": _detector_sql(k) for k in SYNTHETIC} | {
        "detect_counts_documents": f"WITH {docs}, {scanned('d', 'doc_id', 'text')} SELECT category, count(*) AS n FROM m GROUP BY category",
        "detect_all_documents": f"WITH {docs}, {scanned('d', 'doc_id', 'text')} SELECT doc_id, category, matched FROM m",
        "email_by_lang": f"SELECT lang, sum(len({email}))::BIGINT AS n_emails, count(*) FILTER (len({email}) > 0) AS n_docs FROM documents GROUP BY lang",
        "phone_docs": f"SELECT doc_id, trim({found('phone', 'text')}[1]) AS first_phone FROM documents WHERE len({found('phone', 'text')}) > 0",
        "account_bare_pages": f"SELECT page_id, unnest({found('account_bare', 'html')}) AS matched FROM pages",
        "redact_documents": f"{done} SELECT r.doc_id, CASE WHEN d.text IS NOT NULL THEN md5(redacted) END AS redacted_md5, length(redacted)::BIGINT AS n_chars, CASE WHEN hits = '' THEN 0 ELSE len(string_split(rtrim(hits, ';'), ';')) END::BIGINT AS n_hits FROM r JOIN d USING (doc_id)",
        "redaction_counts": f"{done}, x AS (SELECT doc_id, {hit} FROM r WHERE hits <> '') SELECT split_part(h, ':', 1) AS category, sum(split_part(h, ':', 2)::BIGINT)::BIGINT AS n FROM x GROUP BY 1",
        "batch_totals": f"{done}, x AS (SELECT doc_id, {hit} FROM r WHERE hits <> ''), y AS (SELECT source, sum(split_part(h, ':', 2)::BIGINT)::BIGINT AS total, count(DISTINCT split_part(h, ':', 1)) AS n_categories FROM x JOIN documents USING (doc_id) GROUP BY source), u AS (SELECT source, count(*) AS n_units, sum(length(trim(coalesce(text, ''))))::BIGINT AS n_chars FROM documents GROUP BY source) SELECT u.source, n_units, n_chars, coalesce(total, 0) AS total, coalesce(n_categories, 0) AS n_categories FROM u LEFT JOIN y ON u.source IS NOT DISTINCT FROM y.source",
        "verify_documents": f"{again} SELECT (SELECT count(*) FROM documents) AS n_scanned, (SELECT count(DISTINCT doc_id) FROM left_over) AS n_failed",
        "verify_remaining": f"{again} SELECT doc_id, category, count(*) AS remaining FROM left_over GROUP BY ALL",
        "outcomes_documents": f"{again}, x AS (SELECT doc_id, {hit} FROM r WHERE hits <> ''), y AS (SELECT doc_id, sum(split_part(h, ':', 2)::BIGINT)::BIGINT AS total FROM x GROUP BY 1), z AS (SELECT doc_id, count(*) AS n FROM left_over GROUP BY 1) SELECT d.doc_id, coalesce(total, 0) AS total, coalesce(n, 0) AS remaining, (CASE WHEN n > 0 THEN 3 WHEN trim(d.text) = '' THEN 2 ELSE 0 END)::INT AS exit_code FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)",
        "mask_report": f"WITH m AS (SELECT doc_id, unnest({email}) AS m FROM documents) SELECT doc_id, CASE WHEN length(m) <= 4 THEN repeat('*', length(m)) ELSE left(m, 1) || repeat('*', length(m) - 3) || right(m, 2) END AS masked FROM m",
        "header_context_scan": "SELECT c_custkey AS row, 'SSN' AS header, 'ssn' AS category, lpad(c_custkey::VARCHAR, 9, '0') AS matched FROM customer",
        "tabular_vs_text_counts": f"SELECT sum(len({found('account_bare', 'c_name')}))::BIGINT AS n_text, 0::BIGINT AS n_tabular FROM customer",
        "html_to_text": f"SELECT page_id, md5(regexp_replace(replace(replace(replace({text_of}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')) AS text_md5 FROM pages",
        "attr_targets": r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)')) AS a FROM pages) SELECT page_id, regexp_extract(a, '(?is)=\s*["'']?(.*?)["'']?$', 1) AS target FROM a""",
        "custom_terms": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])license(?:[^\p{L}\p{N}_]|$)')",
        "exclude_terms": f"WITH m AS (SELECT DISTINCT doc_id, unnest({email}) AS matched FROM documents) SELECT doc_id, matched FROM m WHERE NOT contains(lower(matched), 'mail1')",
        "preset_counts": f"WITH s AS (SELECT c_custkey AS n FROM customer), t AS (SELECT n, concat_ws(' | ', {', '.join(SYNTHETIC[k] for k in _PRESET_KEYS)}) AS text FROM s), {scanned('t', 'n', 'text', _PRESET_KEYS)}, p AS ({PRESET_ROWS}) SELECT preset, category, count(*) AS n FROM p JOIN m USING (category) GROUP BY ALL",
        "exit_code_severity": "WITH p AS (SELECT user_id, [0, 4, 2, 3][event_id % 4 + 1] AS c FROM events), s AS (SELECT user_id, max(CASE c WHEN 4 THEN 1 ELSE c END) AS s FROM p GROUP BY user_id) SELECT user_id, (CASE s WHEN 1 THEN 4 ELSE s END)::INT AS exit_code FROM s",
        "batch_buckets": f"WITH f AS (SELECT DISTINCT * FROM ({outcome})) SELECT exit_code, count(*) AS n_files FROM f GROUP BY exit_code",
        "batch_names": f"SELECT DISTINCT exit_code, name FROM ({outcome})",
        "page_ranges": "WITH f AS (SELECT conv_id, role, count(*) AS pages FROM conversations GROUP BY ALL), r AS (SELECT conv_id, role, pages, sum(pages) OVER (PARTITION BY conv_id ORDER BY role ROWS UNBOUNDED PRECEDING)::BIGINT AS last_page FROM f) SELECT conv_id, role, last_page - pages + 1 AS first_page, last_page, CASE WHEN pages = 1 THEN last_page::VARCHAR ELSE (last_page - pages + 1)::VARCHAR || '-' || last_page::VARCHAR END AS label FROM r",
        "combine_gate": "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels) l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic = 1",
        "header_join": header,
        "header_window": header,
        "spine_manifest": "WITH s AS (SELECT o_custkey AS book, o_orderkey AS idref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS ord FROM orders), m AS (SELECT DISTINCT l_orderkey AS idref, 'c' || l_partkey::VARCHAR || '.xhtml' AS href FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R') SELECT book, ord, href FROM s JOIN m USING (idref)",
        "sanitise_latin1": r"SELECT doc_id, md5(regexp_replace(replace(replace('█' || chr(9) || text, chr(9), '  '), chr(13), ''), '[^\x{00}-\x{ff}]', '?', 'g')) AS clean_md5 FROM documents",
        "csv_written_and_read": f"WITH {written} SELECT 'nation' || k::VARCHAR || '_redacted.csv' AS file, row, col::INT AS col, text FROM body",
        "workbooks_written_and_verified": f"WITH {written} SELECT 'nation' || k::VARCHAR || '_redacted.xlsx' AS file, count(*) AS n_cells, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (contains(text, '█')) AS n_redacted, 0::BIGINT AS remaining FROM body GROUP BY k",
        "reports_written_and_read": f"{again}, x AS (SELECT doc_id, {hit} FROM r WHERE hits <> ''), y AS (SELECT doc_id, sum(split_part(h, ':', 2)::BIGINT)::BIGINT AS total, count(*) AS n FROM x GROUP BY 1) SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM left_over) AS failed, coalesce(total, 0) AS total, coalesce(n, 0) AS n_details FROM d LEFT JOIN y USING (doc_id)",
        "page_counts": f"WITH {turns}, {scanned('q', 'i', 'text')}, n AS ({count_of}) SELECT category, sum(n)::BIGINT AS n FROM n GROUP BY 1 UNION ALL SELECT 'link', count(*) FROM q",
        "page_sets": f"WITH {turns} SELECT file_id, count(*) AS page_count, {joined('k = 0 AND NOT ocr', 'scanned_pages')}, {joined('ocr', 'ocr_pages')}, {joined('has_images', 'image_pages')}, {joined('has_images AND page_no % 2 = 1', 'flagged_pages')}, (CASE WHEN count(*) FILTER (k = 0 AND NOT ocr) > 0 OR sum(length(trim(text))) = 0 THEN 2 ELSE 0 END)::INT AS exit_code FROM q GROUP BY file_id",
        "match_places": f"WITH m AS (SELECT DISTINCT doc_id, text, unnest({email}) AS matched FROM documents) SELECT doc_id, matched, instr(text, matched)::INT AS first_place, ((length(text) - length(replace(text, matched, ''))) // length(matched))::BIGINT AS n_places FROM m",
        "best_candidate": "SELECT user_id, event_type AS candidate, event_id AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, event_type) AS p FROM events) WHERE p = 1",
        "sheet_titles": "WITH t AS (SELECT p_partkey, p_name || '█ of a long title' AS t FROM part) SELECT p_partkey, left(t, 31) AS title, 1::BIGINT AS n_lost FROM t",
    }
