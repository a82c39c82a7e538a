"""Connected components by label propagation with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stash


def components(links: DataFrame) -> DataFrame:
    """(node, smallest node reachable) of an undirected graph given as links (a, b), as doc_id, comp.

    Each round takes the least label among neighbours, then the label's own
    label, so long chains shorten by half. Only nodes with links are returned.
    Labels are written to the shared folder after each round; the last are
    for the caller to drop.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = stash(both, "edges")
    now = stash(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "doc_id"), "label")
    while True:
        seen = edges.join(now.select(F.col("doc_id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("near"))
        least = now.join(seen, "doc_id").select("doc_id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = least.join(now.select(F.col("doc_id").alias("comp"), F.col("comp").alias("far")), "comp")
        after = stash(jump.select("doc_id", F.least("comp", "far").alias("comp"), "old"), "label")
        changed = not after.where("old <> comp").isEmpty()
        drop(now)
        now = after
        if not changed:
            drop(edges)
            out = now.select("doc_id", "comp")
            out.stash_path = now.stash_path
            return out
