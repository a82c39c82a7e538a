"""Quality by votes of the nearest labelled documents in a latent semantic space."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingle import documents
from .worker import arrow, lean, small_batches

#: Hashed words, and trigrams of 16 kinds of bytes.
WORDS, SHAPES = 2048, 4096
_KIND = np.full(256, 15, np.uint16)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
for _n, _c in enumerate(" \n.,!?|*$%&#"):
    _KIND[ord(_c)] = 3 + _n
_KIND[128:256] = 0  # letters beyond ASCII, mostly


#: Documents of a block, and bytes of text whose trigrams are counted at once.
BLOCK, PIECE = 256, 1 << 18


def _counted(doc: np.ndarray, term: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return np.bincount(doc * terms + term, minlength=docs * terms).reshape(docs, terms)


def features(text: pa.Array) -> Iterator[np.ndarray]:
    """Term counts, damped by a logarithm, of blocks of documents: (documents, WORDS + SHAPES). A long text is counted piece by piece."""
    for i, j, words in documents(text, lower=True):
        n = j - i
        kind = _KIND[words.raw]
        terms = (words.hashes() >> np.uint64(53)).astype(np.int64)
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            a, b = words.ptr[lo], words.ptr[hi]
            out = np.zeros((hi - lo, WORDS + SHAPES), np.float32)
            out[:, :WORDS] = _counted(np.repeat(np.arange(hi - lo), np.diff(words.ptr[lo : hi + 1])), terms[a:b], hi - lo, WORDS)
            for s in range(int(words.offsets[lo]), int(words.offsets[hi]), PIECE):
                t = min(s + PIECE, int(words.offsets[hi]))
                near = np.concatenate([np.zeros(2 - min(s, 2), np.int64), kind[max(s - 2, 0) : t].astype(np.int64)])
                shape = near[:-2] * 256 + near[1:-1] * 16 + near[2:]
                edges = words.offsets[lo : hi + 1]
                begin = np.concatenate([edges[:-1], edges[:-1] + 1])  # no trigram reaches into the document before
                shape[begin[(begin >= s) & (begin < t)] - s] = 0
                cuts = np.clip(edges, s, t)
                first, last = np.searchsorted(edges, [s, t - 1], "right") - 1
                held = _counted(np.repeat(np.arange(last - first + 1), np.diff(cuts[first : last + 2])), shape, last - first + 1, SHAPES)
                out[first : last + 1, WORDS:] += held
            yield np.log1p(out)


@dataclass
class Model:
    """Weights of terms, the latent axes, and labelled unit vectors."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; x is overwritten."""
        weigh(x, self.idf)
        return unit(x @ self.axes)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, weighted by similarity; the whole sample's share where nothing is near. All that tie with the last of the nearest vote."""
        cos = self.latent(x) @ self.vectors.T
        k = min(self.neighbours, cos.shape[1])
        last = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
        w = np.where(cos >= last, np.maximum(cos, 0), 0).astype(np.float64) ** 4
        total = w.sum(axis=1)
        return np.where(total > 0, w @ self.labels / np.maximum(total, 1e-300), self.labels.mean())


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in place; a row of zeros stays."""
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights in place."""
    x *= idf
    return unit(x)


def fit(x: np.ndarray, labels: np.ndarray, rank: int = 48, neighbours: int = 15) -> Model:
    """A model of term counts x, which may be of half precision: they are weighed a block at a time."""
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(1)

    def blocks() -> Iterator[np.ndarray]:
        for lo in range(0, len(x), BLOCK):
            yield weigh(x[lo : lo + BLOCK].astype(np.float32), idf)

    rank = min(rank, *x.shape)
    q = np.random.default_rng(11).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(3):  # subspace iteration
        q, _ = np.linalg.qr(sum(y.T @ (y @ q) for y in blocks()))
    _, _, v = np.linalg.svd(np.concatenate([y @ q for y in blocks()]), full_matrices=False)
    axes = np.ascontiguousarray((q @ v.T)[:, :rank])
    return Model(idf, axes, np.concatenate([unit(y @ axes) for y in blocks()]), labels.astype(np.float64), neighbours)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = [zlib.compress(row.astype(np.float16).tobytes(), 1) for block in features(batch.column("text")) for row in block]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(flat, pa.binary())], ["doc_id", "label", "x"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model of all rows, which are few."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "x")), strict=True)]
    if rows:
        rows.sort(key=lambda r: r[:2])
        x = np.empty((len(rows), WORDS + SHAPES), np.float16)
        for i, r in enumerate(rows):
            x[i] = np.frombuffer(zlib.decompress(r[2]), np.float16)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(x, np.array([r[1] for r in rows])))]})


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> Model | None:
    """A model from at most ``per_class`` labelled documents of either label, chosen by hash; None without labels. labels: doc_id, label (0 or 1). Of rows that share a doc_id the least text counts. Those few rows are fitted in one task; the driver gets the model."""
    known = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = reduce(DataFrame.union, [known.join(docs.select("doc_id"), "doc_id", "left_semi").where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)])
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).transform(arrow(_features, "doc_id long, label int, x binary"))
    found = rows.repartition(1).transform(arrow(_fit, "model binary")).collect()
    return pickle.loads(found[0].model) if found else None


def _score(shared):
    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for text in texts:
            parts = [np.full(len(text), 0.5)] if model is None else [model.scores(x) for x in features(text)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return work


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a column ``quality_score``, 0 to 1, of each whole text.

    Every document is compared with all labelled vectors, in blocks. Null text
    counts as empty; empty texts get the vote like others. Without any label
    each score is 0.5. All columns and rows are kept, whatever their names; a
    column of the same name is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    votes = F.arrow_udf(lean(_score(spark.sparkContext.broadcast(model))), "double", F.ArrowUDFType.SCALAR_ITER)
    return docs.drop("quality_score").withColumn("text", F.col("text").cast("string")).withColumn("quality_score", votes(F.col("text")))
