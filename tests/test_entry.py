"""The driver contract: names, columns and oracle agree."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkveil.operators.detect import hits
from inkveil.plans import queries as core

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["detector_routing_bare", "redact_documents", "attr_targets", "page_ranges", "preset_counts", "combine_gate", "detect_all_documents", "page_sets", "csv_written_and_read"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = core.queries()[name](spark, SF).toPandas()
    want = con.execute(core.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


def test_near_misses_find_nothing(spark):
    """Texts of a detector's shape that are none of its own."""
    n = spark.range(3, 1200, 3).select(F.col("id").alias("n"))  # the customers that get them
    found = n.select(*(F.sum(F.size(hits(F.expr(text), core.BY_KEY[key]))).alias(key) for key, text in core.MISSES.items())).first().asDict()
    assert set(found) == set(core.SYNTHETIC) and not any(found.values()), {k: v for k, v in found.items() if v}


@pytest.mark.parametrize("name", ["preset_counts", "detector_ssn", "header_context_scan", "tabular_vs_text_counts"])
def test_customers_are_dealt_out(spark, name):
    """A file of one row group is one task; the scan's work has to go to all cores all the same."""
    plan = core.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert re.search(r"Exchange RoundRobinPartitioning\((\d+)\)", plan) and int(re.search(r"Exchange RoundRobinPartitioning\((\d+)\)", plan)[1]) >= 4 * spark.sparkContext.defaultParallelism
