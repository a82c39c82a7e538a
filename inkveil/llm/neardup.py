"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of shingles gives a signature of HASHES symbols, each the
low 16 bits of one minhash. Two signatures differ in some number of symbols;
the join finds every pair that differs in at most MOST of them: the signature
is cut into CHUNKS chunks of four, so by pigeonhole some chunk has at most one
error, and each chunk is indexed once for each place where its error may be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .narrow import named, unnamed
from .shingle import Words, documents, flat, mix, runs, signed
from .store import drop, stash
from .worker import arrow

WIDTH, CHUNKS = 4, 14
HASHES = WIDTH * CHUNKS
#: Errors that leave a chunk with at most one: 2 * CHUNKS - 1. A pair of similarity 0.8 has more with probability 5e-7.
MOST = 2 * CHUNKS - 1
#: Members of a bucket that one block holds at most, and their shingles where sets are compared.
BLOCK = 512
BLOCK_SHINGLES = 1 << 18
_RNG = np.random.default_rng(77)
_MUL = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer than k words: the sequence as one shingle; none: empty."""
    for i, j, words in documents(text, lower=True):
        wh = words.hashes()
        h, doc, _ = words.shingles(k, wh)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            n = words.ptr[d + 1] - words.ptr[d]
            if n >= k:
                yield np.unique(h[cut[d] : cut[d + 1]])
            elif n:
                yield runs(wh[words.ptr[d] : words.ptr[d + 1]], int(n))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of HASHES minhashes; the permutations are affine on the upper half of the mixed hashes."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(values), 1024):
        np.minimum(low, (values[None, i : i + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=low)
    return (mix(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _sign(k: int, keep: bool = False):
    """The size, fingerprints and signature of each row's set; with ``keep`` its text too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                one.append(int(signed(np.add.reduce(mix(s, 1), keepdims=True))[0]))
                two.append(int(signed(np.add.reduce(mix(s, 2), keepdims=True))[0]))
                sig.append(signature(s).tobytes())
            kept = [batch.column("text")] * keep
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary()), *kept], [*SIGNED, *["text"] * keep])

    return work


#: Columns of a document's set: its size, two fingerprints that stand for it, and its signature.
SIGNED = ["doc_id", "n_shingles", "f1", "f2", "sig"]
_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, sig binary"
SET = ["n_shingles", "f1", "f2"]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature under the keys of all its chunks: the chunk with any one symbol left out."""
    three = [[j for j in range(WIDTH) if j != out] for out in range(WIDTH)]
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys = np.stack([reduce(lambda a, j: (a << np.uint64(16)) | sig[:, :, j], cols, np.full(sig.shape[:2], out, np.uint64)) for out, cols in enumerate(three)], axis=2)
        keys |= (np.arange(CHUNKS, dtype=np.uint64) << np.uint64(56))[None, :, None]
        n = CHUNKS * WIDTH
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(np.repeat(ids, n))], ["key", "doc_id"])


def _distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose signatures differ in at most MOST symbols."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a != b).sum(axis=1) <= MOST))


def _confirm(k: int, percent: int):
    """Keeps pairs whose whole shingle sets are similar enough, by the words themselves: the texts of a batch are numbered together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
            place = {t: i for i, t in enumerate(dict.fromkeys(chain(*sides)))}
            sets = Words(*flat(pa.array(place, pa.large_string())), lower=True).numbered(k)
            ok = []
            for x, y in zip(*sides, strict=True):
                a, b = sets[place[x]], sets[place[y]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return work


def _confirmed(pairs: DataFrame, signed_docs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b): by signature first, then on full sets."""
    sig = signed_docs.select("doc_id", "sig")
    near = (
        pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b")
        .transform(arrow(_distance, "a long, b long"))
    )
    near = stash(near, "near")
    wanted = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    texts = stash(named(texts, wanted), "texts")
    full = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = stash(full.select("a", "b", "text_a", "text_b").transform(arrow(_confirm(k, percent), "a long, b long")), "links")
    drop(near, texts)
    return links


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a pair of blocks of one bucket: members with a partner of another component that is near by signature.

    A pair shares several buckets; only that of the first key counts it.
    """
    for batch in batches:
        keys, docs = [], []
        for key, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "left", "right")), strict=True):
            index = (key >> 56 & 0xFF) * WIDTH + (key >> 48 & 0xFF)
            (ia, ca, sa), (ib, cb, sb) = (
                (np.array([x["doc_id"] for x in block]), np.array([x["comp"] for x in block]), np.frombuffer(b"".join(x["load"] for x in block), np.uint16).reshape(-1, HASHES)) for block in (left, right)
            )
            hit_a, hit_b = np.zeros(len(ia), bool), np.zeros(len(ib), bool)
            for r in range(len(ia)):
                at = np.flatnonzero(cb != ca[r])
                same = sb[at] == sa[r]
                near = same.sum(axis=1) >= HASHES - MOST
                at, same = at[near], same[near].reshape(-1, CHUNKS, WIDTH)
                shared = same.sum(axis=2, keepdims=True) - same == WIDTH - 1
                at = at[shared.reshape(-1, CHUNKS * WIDTH).argmax(axis=1) == index] if len(at) else at
                hit_a[r] = len(at) > 0
                hit_b[at] = True
            some = np.unique(np.r_[ia[hit_a], ib[hit_b]])
            keys += [key] * len(some)
            docs += some.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64())], ["key", "doc_id"])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by matrix products over the values that both lists hold."""
    va, vb = np.concatenate(a), np.concatenate(b)
    values = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    at_a, at_b = np.searchsorted(values, va), np.searchsorted(values, vb)
    in_a, in_b = np.isin(va, values), np.isin(vb, values)
    for lo in range(0, len(values), 4096):
        sides = []
        for at, inside, rows, n in ((at_a, in_a, rows_a, len(a)), (at_b, in_b, rows_b, len(b))):
            use = inside & (at >= lo) & (at < lo + 4096)
            m = np.zeros((n, min(4096, len(values) - lo)), np.float32)
            m[rows[use], at[use] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _linked(k: int, percent: int):
    """Of a pair of blocks of one bucket: links between different components, as many as connect them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for left, right in zip(*(batch.column(c).to_pylist() for c in ("left", "right")), strict=True):
                (ia, ca), (ib, cb) = (([x["doc_id"] for x in block], np.array([x["comp"] for x in block])) for block in (left, right))
                sets = Words(*flat(pa.array([x["load"] for x in [*left, *right]])), lower=True).numbered(k)
                sa, sb = sets[: len(left)], sets[len(left) :]
                both = _overlaps(sa, sb)
                whole = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :] - both
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for i, j in zip(*np.nonzero((both > 0) & (100 * both >= percent * whole) & (ca[:, None] != cb[None, :])), strict=True):
                    x, y = find(int(ca[i])), find(int(cb[j]))
                    if x != y:
                        root[x] = y
                        out_a.append(ia[i])
                        out_b.append(ib[j])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return work


def _blocks(member: DataFrame, weight, most: int, load: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks of a bucket that cover all pairs of its members but those within the pivot's component, and the blocks.

    member: key, doc_id, comp, home. A block holds rows up to a weight of
    ``most``. Pairs are named first and dealt out by block, so the pairs of one
    large bucket are the work of many tasks.
    """
    before = F.sum("weight").over(Window.partitionBy("key", "inside").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = member.withColumn("inside", F.col("comp") == F.col("home")).withColumn("weight", weight)
    blocks = rows.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / most)).groupBy("key", "inside", "block").agg(F.collect_list(F.struct("doc_id", "comp", F.col(load).alias("load"))).alias("rows"))
    blocks = stash(blocks, "blocks")
    if blocks.where("block > 0").isEmpty():
        one = blocks.where("not inside").select("key", F.col("rows").alias("left"))
        return one.join(blocks.select("key", F.col("rows").alias("right")), "key").select("key", "left", "right"), blocks
    names = blocks.select("key", "inside", "block")
    pairs = names.where("not inside").select("key", F.col("block").alias("n")).join(names, "key").where("inside or block >= n")
    left = blocks.where("not inside").select("key", F.col("block").alias("n"), F.col("rows").alias("left"))
    right = blocks.select("key", "inside", "block", F.col("rows").alias("right"))
    return pairs.join(left, ["key", "n"]).join(right, ["key", "inside", "block"]).select("key", "left", "right"), blocks


def _rest(keys: DataFrame, comps: DataFrame, signed_docs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of different components that share a bucket and were not compared with its pivot.

    A bucket whose other members are one component drops out. Members of the
    pivot's component need no test among themselves. What leaves a task is
    members and connecting links, never pairs.
    """
    member = keys.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    home = member.groupBy("key").agg(F.min(F.when(F.col("doc_id") == F.col("pivot"), F.col("comp"))).alias("home"), F.min(F.when(F.col("doc_id") != F.col("pivot"), F.col("comp"))).alias("lo"), F.max(F.when(F.col("doc_id") != F.col("pivot"), F.col("comp"))).alias("hi")).where("lo <> hi").select("key", "home")
    member = member.where("doc_id <> pivot").select("key", "doc_id", "comp").join(home, "key")
    loaded = member.join(signed_docs.select("doc_id", "sig"), "doc_id")
    pairs, blocks = _blocks(loaded, F.lit(1), BLOCK, "sig")
    some = stash(pairs.transform(arrow(_partnered, "key long, doc_id long")).distinct().join(member, ["key", "doc_id"]), "partnered")
    drop(blocks)
    wanted = some.select("doc_id").distinct()
    texts = stash(named(texts, wanted), "texts")
    loaded = some.join(texts, "doc_id").join(signed_docs.select("doc_id", "n_shingles"), "doc_id")
    weight = F.greatest(F.col("n_shingles"), F.lit(BLOCK_SHINGLES // BLOCK))
    pairs, blocks = _blocks(loaded, weight, BLOCK_SHINGLES, "text")
    links = stash(pairs.select("left", "right").transform(arrow(_linked(k, percent), "a long, b long")), "links")
    drop(blocks, some, texts)
    return links


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """A table of rows with a column node: first, first + 1, ..., without bringing them together."""
    held = stash(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("at", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    node = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + first
    out = stash(held.withColumn("part", part).join(F.broadcast(before), "part").withColumn("node", node).drop("at", "part", "before"), "others")
    drop(held)
    return out


def _other_sets(docs: DataFrame, one: DataFrame, k: int) -> DataFrame | None:
    """Of ids whose rows have different sets: each set but the largest under a number of its own, beyond all ids, with a text; None if there are none."""
    twice = stash(one.where(F.struct(*SET) != F.col("least")).select("doc_id"), "twice")
    if twice.isEmpty():
        drop(twice)
        return None
    rows = named(docs, twice).transform(arrow(_sign(k, True), f"{_SIGNED}, text string")).where("n_shingles > 0")
    rows = rows.groupBy("doc_id", *SET).agg(F.min("sig").alias("sig"), F.min("text").alias("text"))
    top = one.agg(F.max("doc_id")).first()[0]
    found = _numbered(rows.join(one.select("doc_id", *SET, F.lit(True).alias("main")), ["doc_id", *SET], "left"), top + 1)
    drop(twice)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of percent / 100 or more.

    Equal sets are one class, represented by its smallest doc_id, so copies
    are never paired. Within an index bucket every member is first compared
    with one pivot only, the member that shares most buckets with others;
    members that end in one component need no more, and what is left is
    compared in blocks, on whole sets. No bucket is cut or capped. A link is
    confirmed on the words themselves; classes are told by 128 bits of keyed
    hashes of them.

    Returns doc_id, n_shingles, component_id, kept for each distinct doc_id.
    Null or wordless text: an empty set, linked with nothing. Null doc_id: not
    a document, left out. Rows that share a doc_id are one document, linked
    with all that any of its rows is linked with; n_shingles is that of its
    largest set. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    every = stash(docs.transform(arrow(_sign(k), _SIGNED)), "signed")
    one = every.groupBy("doc_id").agg(F.max(F.struct(*SET, "sig")).alias("x"), F.min(F.struct(*SET)).alias("least")).select("doc_id", "x.*", "least")
    others, texts = _other_sets(docs, one, k), docs
    full = one.where("n_shingles > 0").select(*SIGNED)
    if others:
        node = F.when(F.col("main"), F.col("doc_id")).otherwise(F.col("node")).alias("doc_id")
        full = full.union(others.where("main is null").select(F.col("node").alias("doc_id"), *SIGNED[1:]))
        texts = unnamed(docs, others.select("doc_id")).union(others.select(node, "text"))
    reps = stash(full.groupBy(*SET).agg(F.min(F.struct("doc_id", "sig")).alias("x")).select(*SET, "x.*"), "reps")
    keys = reps.select("doc_id", "sig").transform(arrow(_index, "key long, doc_id long"))
    beside = Window.partitionBy("key").orderBy("doc_id")
    shared = stash(keys.withColumn("other", F.coalesce(F.lag("doc_id").over(beside), F.lead("doc_id").over(beside))).where("other is not null").select("key", "doc_id"), "shared")
    met = shared.join(shared.groupBy("key").count(), "key").groupBy("doc_id").agg(F.sum("count").alias("met"))
    pivot = F.first("doc_id").over(Window.partitionBy("key").orderBy(F.desc("met"), "doc_id"))
    keys = stash(shared.join(met, "doc_id").select("key", "doc_id", pivot.alias("pivot")), "keys")
    drop(shared)
    first = keys.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    first_links = _confirmed(first, reps, texts, k, percent)
    comps = components(first_links)
    more = _rest(keys, comps, reps, texts, k, percent)
    links = first_links.union(more)
    if others:
        of = reps.select(*SET, F.col("doc_id").alias("b"))
        main = one.select("doc_id", *SET).join(of.withColumnRenamed("b", "a"), SET).select("doc_id", "a")
        links = links.union(others.where("main is null").join(of, SET).join(main, "doc_id").select("a", "b"))
    drop(comps)
    comps = components(links)
    drop(keys, first_links, more)
    classes = reps.join(comps, "doc_id", "left").select(*SET, F.coalesce("comp", "doc_id").alias("component_id"))
    return (
        one.select("doc_id", *SET)
        .join(classes, SET, "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
