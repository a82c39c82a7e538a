"""Benchmark items inside documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stash

#: Rows of item sketches up to which they are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 4_000_000


def _once(value: Column, body) -> Column:
    """body(value), with value computed once: a column named in a lambda would be computed again at each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(values: Column, k: int | Column, of) -> Column:
    """of(run) for each run of k elements; none if there are fewer."""
    return _once(values, lambda v: F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.size(v) - k), lambda i: i >= 0), lambda i: of(F.slice(v, i + 1, F.lit(k))))))


def shingles(ws: Column, k: int | Column) -> Column:
    return _runs(ws, k, lambda run: F.array_join(run, " "))


def shingle_hashes(ws: Column, k: int | Column) -> Column:
    return _runs(F.transform(ws, lambda w: F.xxhash64(w)), k, lambda run: F.xxhash64(run))


def _short(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    """Pairs of a document and an item of fewer than k words, which is one shingle of its own length; None without such items."""
    few = items.where((F.size("ws") > 0) & (F.size("ws") < k)).select("item_id", F.size("ws").alias("m"), shingles(F.col("ws"), F.size("ws"))[0].alias("said"), shingle_hashes(F.col("ws"), F.size("ws"))[0].alias("key"))
    few = few.groupBy("m", "said", "key").agg(F.min("item_id").alias("item_id"))
    sizes = {r["m"]: r["count"] for r in few.groupBy("m").count().collect()}
    if not sizes:
        return None
    listed = F.broadcast(few) if sum(sizes.values()) <= BROADCAST_ROWS else few
    ws = words(F.col("text"))
    keys = F.array(*(F.struct(F.lit(m).alias("m"), shingle_hashes(ws, m).alias("keys")) for m in sorted(sizes)))
    runs = docs.select("doc_id", F.explode(keys).alias("x")).select("doc_id", "x.m", F.explode("x.keys").alias("key"))
    hit = stash(runs.join(listed, ["m", "key"]).select("doc_id", "item_id", "m", "said").distinct(), "short")
    texts = docs.join(hit.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", ws.alias("ws"))
    pairs = hit.join(texts, "doc_id").where(F.array_contains(shingles(F.col("ws"), F.col("m")), F.col("said"))).select("doc_id", "item_id").distinct()
    return pairs.select("doc_id", "item_id", F.lit(1).cast("long").alias("n_shingles"), F.lit(1).cast("long").alias("n_shared"), F.lit(1.0).alias("containment"))


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of a document and a test item of whose k-word shingles it holds at least ``percent``.

    Items are partitioned by size: an item of n shingles is in the class of
    the power of two at or below n, and the class says how many hits its
    sketch must have, R = 0.4 times that power. The sketch holds the
    a + R least of the item's shingles in a hashed order (a bottom-k MinHash),
    where a is how many shingles a document may lack. So each true container
    hits at least R sketch entries, whatever its own length, and none is lost.
    Candidates are then verified on the shingles themselves.

    Items with the same shingles are one, named by the smallest item_id.
    An item of fewer than k words is one shingle of its own length, looked for
    among runs of as many words (a run of letters or digits is a word, also
    where a script has no spaces).

    Returns doc_id, item_id, n_shared, n_shingles, containment. Null texts and
    items without words: no pairs. Null ids: left out. Rows that
    share a doc_id count as one pair with the larger n_shared. Empty tables:
    no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("ws")).where("item_id is not null")
    few = _short(docs, items, k)
    items = items.where(F.size("ws") >= k).select("item_id", F.array_sort(shingles(F.col("ws"), k)).alias("item_shingles"), shingle_hashes(F.col("ws"), k).alias("keys"))
    items = items.groupBy("item_shingles").agg(F.min("item_id").alias("item_id"), F.first("keys").alias("keys"))
    n = F.size("item_shingles")
    need = F.ceil(n * percent / 100).cast("int")
    items = items.select("item_id", "item_shingles", n.alias("n"), need.alias("need"), F.greatest(F.lit(1), F.floor(0.4 * F.pow(F.lit(2), F.floor(F.log2(n.cast("double")))))).cast("int").alias("hits"), "keys")
    least = F.array_sort(F.transform("keys", lambda x: F.struct(F.xxhash64(x, F.lit(1)).alias("o"), x.alias("key"))))
    sketch = items.select("item_id", "need", "hits", F.explode(F.slice(least, F.lit(1), F.least(F.size("keys"), F.col("n") - F.col("need") + F.col("hits")))).alias("s")).select("item_id", "need", "hits", F.col("s.key").alias("key"))
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    hashed = docs.select("doc_id", F.explode(F.array(shingle_hashes(words(F.col("text")), k))).alias("keys"))
    hashed = hashed.select("doc_id", F.size("keys").alias("size"), F.explode("keys").alias("key"))
    hit = hashed.join(sketch, "key").where("size >= need").groupBy("doc_id", "item_id", "hits").count().where("count >= hits")
    near = stash(hit.select("doc_id", "item_id").distinct(), "hits")
    texts = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", shingles(words(F.col("text")), k).alias("doc_shingles"))
    full = near.join(texts, "doc_id").join(items.select("item_id", "item_shingles", "n", "need"), "item_id")
    shared = full.select("doc_id", "item_id", F.size(F.array_intersect("doc_shingles", "item_shingles")).cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_shingles"), "need").where("n_shared >= need")
    found = shared.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared")).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return found.unionByName(few) if few is not None else found
