"""Batches: exit codes, attachments, and the gate before outputs are combined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogue import SEVERITY
from ..functions.checks import safe_name
from ..sources.containers import messages

#: Attachments taken from a message, bytes of each, and levels of messages in messages.
MAX_ATTACHMENTS, MAX_BYTES, MAX_DEPTH = 50, 100 * 1024 * 1024, 2


def severity(code):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), code), F.lit(0))


def worst(parts: DataFrame, key: str) -> DataFrame:
    """The gravest exit code of a file's parts."""
    return parts.groupBy(key).agg(F.max_by("exit_code", severity(F.col("exit_code"))).alias("exit_code"))


def buckets(outcomes: DataFrame) -> DataFrame:
    """Number of files by exit code. Their names are :func:`names`, a row each, as they may be many."""
    return outcomes.groupBy("exit_code").agg(F.count(F.lit(1)).alias("n_files")).orderBy("exit_code")


def names(outcomes: DataFrame, name: str) -> DataFrame:
    """Files in order of exit code and name."""
    return outcomes.select("exit_code", F.col(name).alias("name")).orderBy("exit_code", "name")


def attachments(messages: DataFrame, key: str) -> DataFrame:
    """Attachments (name, blob, skip) of messages by ordinal; beyond the caps a reason to skip stands in."""
    rows = messages.select(key, F.posexplode("attachments").alias("ord", "a")).select(key, "ord", "a.*")
    why = F.when(F.col("ord") >= MAX_ATTACHMENTS, "too many attachments").when(F.length("blob") > MAX_BYTES, "attachment too large").otherwise(F.col("skip"))
    return rows.withColumn("skip", why)


def attached_files(mails: DataFrame) -> DataFrame:
    """Files attached to mails (path, name, content) and to mails attached to them, to MAX_DEPTH, as files that can be scanned.

    Returns path, name (the mail's stem, att, the ordinal from 1 and a safe
    name), length, content, depth, skip. What is skipped, is too deep or is
    the error of a broken mail has no content and a reason.
    """
    out, level = None, mails.select("path", "name", "content")
    for depth in range(MAX_DEPTH + 1):
        read = messages(level).join(level.select("path", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem")), "path")
        broken = read.where("error is not null").select("path", F.concat("stem", F.lit(".eml")).alias("name"), F.lit(None).cast("binary").alias("content"), F.col("error").alias("skip"))
        parts = attachments(read.withColumn("key", F.struct("path", "stem")), "key").select("key.*", "ord", "name", "blob", "skip")
        safe = F.concat(F.col("stem"), F.lit("_att"), (F.col("ord") + 1).cast("string"), F.lit("_"), safe_name(F.col("name"), F.col("ord") + 1))
        nested = F.lower("name").endswith(".eml") & F.lit(depth == MAX_DEPTH)
        why = F.coalesce("skip", F.when(nested, F.lit(f"mails are opened to {MAX_DEPTH} levels")))
        parts = parts.select(F.concat("path", F.lit("/"), safe).alias("path"), safe.alias("name"), F.when(why.isNull(), F.col("blob")).alias("content"), why.alias("skip"))
        found = parts.unionByName(broken).withColumn("depth", F.lit(depth))
        out = found if out is None else out.unionByName(found)
        level = parts.where(F.col("skip").isNull() & F.lower("name").endswith(".eml")).select("path", "name", "content")
    return out.select("path", "name", F.length("content").cast("long").alias("length"), "content", "depth", "skip")


def gate(outputs: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Outputs that stop a merge: no report, or one that is not a pass. No rows: all may be combined."""
    bad = F.coalesce(F.contains("report", F.lit("*** FAIL")), F.lit(True)) | (F.coalesce("exit_code", F.lit(0)) != 0)
    have = reports if "exit_code" in reports.columns else reports.withColumn("exit_code", F.lit(0))
    return outputs.join(have.select(key, "report", "exit_code"), key, "left").where(bad).select(outputs.columns)


def page_ranges(files: DataFrame, group: str, name: str, pages: str) -> DataFrame:
    """First and last page of each file in the merged output of its group, in order of name; label first-last, or one number."""
    run = F.sum(pages).over(Window.partitionBy(group).orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    out = files.withColumn("last_page", run).withColumn("first_page", F.col("last_page") - F.col(pages) + 1)
    return out.withColumn("label", F.when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", "first_page", "last_page")))


def flagged_pages(image_pages, barcode_pages):
    """Pages with images but no barcode found: for a person to look at."""
    return F.array_except(image_pages, barcode_pages)
