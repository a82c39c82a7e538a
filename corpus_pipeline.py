"""A training-data pipeline in five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import leaks, narrow, neardup, packing, quality, secrets, store
from inkveil.llm.queries import VOCABULARY, held_out, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Columns of documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.select("doc_id", "text").where(~held_out()), labels.where(~held_out()))
    return quality.score(docs, model).where("quality_score >= 0.3").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the one of smallest doc_id. Null ids stay."""
    lost = store.stash(neardup.near_duplicates(docs).where("not kept").select("doc_id"), "lost")
    return narrow.unnamed(docs, lost)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    hit = store.stash(leaks.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "hit")
    return narrow.unnamed(docs, hit)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    found = secrets.find_secrets(docs, secrets.train(secrets.labelled_findings(spark)))
    return secrets.mask_secrets(docs, found)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: Learned and iterative stages have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage leaves behind is deleted once the next has its rows.

    Null texts count as empty, null ids are documents of their own that no
    stage can drop as a copy or a leak, rows that share an id go or stay
    together where ids decide. Empty tables give no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with store.scope() as made:
            docs = store.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.remove(docs.stash_path)
        store.drop(before)
        before = docs
    return docs
