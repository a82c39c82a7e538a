"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, stash
from .worker import arrow

ORDER = 5
#: Symbols at least: 0 for anything that is no letter, one for each letter of the sample, and the last for all others.
SYMBOLS = 64
#: Shares of a language that are ranked apart before the sample is chosen.
SHARES = 64
_POINTS = 0x110000
#: An n-gram's key is the sum of its symbols' hashes times powers of this odd number, in 64 bits; _BACK undoes one power.
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(ORDER)], np.uint64)
_ALPHA: list[np.ndarray] = []
_CHUNK = 1 << 20


def _alpha() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.array([chr(c).isalpha() for c in range(_POINTS)]))
    return _ALPHA[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(codes: np.ndarray) -> bool:
    return bool(_alpha()[codes].any())


def _mix(symbols: np.ndarray) -> np.ndarray:
    """Hashes of symbols (the finalizer of splitmix64)."""
    x = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(grams: np.ndarray) -> np.ndarray:
    """Keys of n-grams, a row of symbols each; the last symbol has power 0."""
    out = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        out += _mix(grams[:, -1 - k]) * _POWERS[k]
    return out


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams by key, and how often each is there."""
    _, first, n = np.unique(_keys(grams), return_index=True, return_counts=True)
    return grams[first], n


@dataclass
class Model:
    """For each order: sorted n-gram keys with a log probability a language, and sorted context keys with a log back-off weight a language."""

    langs: list[str]
    table: np.ndarray
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    scale: float = 1.0
    reject: float = float("inf")

    def symbols(self, text: str) -> np.ndarray:
        """The text in symbols, after ORDER - 1 blanks; runs of blanks are one."""
        s = self.table[_codes(text)]
        keep = s != 0
        keep[1:] |= s[:-1] != 0
        return np.concatenate([np.zeros(ORDER - 1, np.uint32), s[keep], np.zeros(1, np.uint32)])

    def entropies(self, rows: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy a symbol, of each row in each language."""
        flat = _mix(np.concatenate(rows))
        ends = np.cumsum([len(r) for r in rows])
        starts = ends - [len(r) for r in rows]
        key = np.zeros(len(flat), np.uint64)
        for k in range(ORDER):
            key[ORDER - 1 :] += flat[ORDER - 1 - k : len(flat) - k] * _POWERS[k]
        real = np.ones(len(flat), bool)
        for k in range(ORDER - 1):
            real[starts + k] = False
        k, place = key[real], np.flatnonzero(real)
        out = np.zeros((len(k), len(self.langs)), np.float32)
        todo = np.arange(len(k))
        for n in range(ORDER, 0, -1):
            at = np.searchsorted(self.keys[n], k)
            at[at == len(self.keys[n])] = 0
            hit = self.keys[n][at] == k
            out[todo[hit]] += self.logp[n][at[hit]]
            todo, k = todo[~hit], k[~hit]
            if not len(todo):
                break
            context = (k - flat[place[todo]]) * _BACK
            at = np.searchsorted(self.contexts[n], context)
            at[at == len(self.contexts[n])] = 0
            seen = self.contexts[n][at] == context
            out[todo[seen]] += self.weight[n][at[seen]]
            k = k - flat[place[todo] - (n - 1)] * _POWERS[n - 1]
        sizes = ends - starts - (ORDER - 1)
        begin = np.cumsum(sizes) - sizes
        return -np.add.reduceat(out.astype(np.float64), begin, axis=0) / sizes[:, None]

    def confidence(self, ce: np.ndarray) -> np.ndarray:
        best = ce.min(axis=1, keepdims=True)
        return 1 / np.exp(-(ce - best) * self.scale).sum(axis=1)


def _order(grams: list[np.ndarray], lower: np.ndarray | None, lower_keys: np.ndarray | None, counts: list[np.ndarray], symbols: int):
    """One order of every language: discount D = n1 / (n1 + 2 n2), interpolated with the order below."""
    every = np.concatenate(grams)
    keys, first = np.unique(_keys(every), return_index=True)
    every = every[first]
    contexts, of = np.unique(_keys(every[:, :-1]), return_inverse=True)
    logp, weight = np.zeros((len(keys), len(grams))), np.zeros((len(contexts), len(grams)))
    below = np.full((len(keys), len(grams)), 1 / symbols) if lower is None else np.exp(lower[np.searchsorted(lower_keys, _keys(every[:, 1:]))])
    for lang, (g, c) in enumerate(zip(grams, counts, strict=True)):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        full = np.zeros(len(keys))
        full[np.searchsorted(keys, _keys(g))] = c
        total = np.bincount(of, full, len(contexts))
        kinds = np.bincount(of, full > 0, len(contexts))
        gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(full - d, 0) / np.maximum(total, 1)[of] + gamma[of] * below[:, lang]
        logp[:, lang], weight[:, lang] = np.log(p), np.log(gamma)
    return keys, logp.astype(np.float32), contexts, weight.astype(np.float32)


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows; every fifth row calibrates the confidence and the rejection threshold."""
    langs = sorted({lang for lang, _ in rows})
    seen = np.zeros(_POINTS, bool)
    for _, text in rows:
        seen[_codes(text)] = True
    letters = np.flatnonzero(seen & _alpha())
    symbols = max(SYMBOLS, len(letters) + 2)
    table = np.where(_alpha(), symbols - 1, 0).astype(np.uint32)
    table[letters] = np.arange(1, 1 + len(letters))
    model = Model(langs, table, *([np.zeros(0, np.uint64)] for _ in range(4)))
    if not langs:
        return model
    by = {lang: [t for x, t in rows if x == lang] for lang in langs}
    held = [(lang, t) for lang in langs for t in by[lang][4::5]]
    raw: list[tuple[np.ndarray, np.ndarray]] = []
    for lang in langs:
        some = [model.symbols(t) for i, t in enumerate(by[lang]) if i % 5 != 4]
        grams = np.lib.stride_tricks.sliding_window_view(np.concatenate(some), ORDER)  # no copy
        within = np.ones(len(grams), bool)
        for end in np.cumsum([len(s) for s in some])[:-1]:
            within[end - ORDER + 1 : end] = False
        at = np.flatnonzero(within)
        _, first, n = np.unique(_keys(grams)[at], return_index=True, return_counts=True)
        raw.append((grams[at[first]], n))
    # Below the top order a count is the number of different symbols that come before.
    tables = {ORDER: raw}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = [_distinct(g[:, 1:]) for g, _ in tables[n + 1]]
    whole = (np.arange(symbols, dtype=np.uint32)[:, None], np.zeros(symbols, np.int64))
    lower = keys = None
    for n in range(1, ORDER + 1):
        grams, counts = [g for g, _ in tables[n]], [c for _, c in tables[n]]
        if n == 1:  # every symbol has an entry, so the last back-off always ends
            full = [whole[1].copy() for _ in langs]
            for f, g, c in zip(full, grams, counts, strict=True):
                f[g[:, 0]] = c
            grams, counts = [whole[0]] * len(langs), full
        keys, lower, contexts, weight = _order(grams, lower, keys, counts, symbols)
        for store, value in zip((model.keys, model.logp, model.contexts, model.weight), (keys, lower, contexts, weight), strict=True):
            store.append(value)
    if held:
        ce = np.concatenate([model.entropies([model.symbols(t)]) for _, t in held])
        right = np.array([langs.index(lang) for lang, _ in held])
        own = ce[np.arange(len(right)), right]
        scales = [0.5, 1, 2, 4, 8, 16, 32]
        losses = []
        for s in scales:
            z = -ce * s
            losses.append(float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(right)), right]).mean()))
        model.scale = scales[int(np.argmin(losses))]
        model.reject = float(np.quantile(own, 0.995) * 1.25)
    return model


def training_rows(docs: DataFrame, per_language: int = 400, longest: int = 20_000, most: int = 40_000) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language, by hash, and ``most`` of all; of texts over ``longest`` characters, which come after all others, the beginning.

    Those three bound what is learned from, so the chosen ids, which are
    broadcast, are bounded too. With more than ``most / per_language``
    languages each has as many fewer rows, and more than ``most`` languages
    are an error. Of rows that share a doc_id and a language one counts: the
    least text.
    """
    docs = docs.where("lang is not null and text is not null and doc_id is not null")
    some = docs.select("lang", "doc_id", (F.length("text") > longest).alias("long")).groupBy("lang", "doc_id").agg(F.min("long").alias("long"))
    order = [F.col("long"), F.xxhash64("doc_id"), F.col("doc_id")]
    # The first of a language are among the first of its shares, so no task ranks a whole language.
    some = some.withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES)))
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("n") <= per_language)
    ids = stash(some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= per_language).select("lang", "doc_id", "n"), "sample")
    langs = ids.select("lang").distinct().count()
    if langs > most:
        raise ValueError(f"{langs} languages, but at most {most} rows are learned from")
    few = ids.where(F.col("n") <= max(1, most // max(langs, 1)))
    chosen = docs.join(F.broadcast(few), ["lang", "doc_id"]).groupBy("lang", "n").agg(F.min(F.substring("text", 1, longest)).alias("text"))
    rows = [(r.lang, r.text) for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.n))]
    drop(ids)
    return rows


def _predict(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score, entropy, rejected = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
            at, rows, size = [], [], 0

            def settle() -> None:
                nonlocal at, rows, size
                if rows:
                    ce = model.entropies(rows)
                    best, sure = ce.argmin(axis=1), model.confidence(ce)
                    for i, b, s, e in zip(at, best, sure, ce.min(axis=1), strict=True):
                        lang[i], score[i], entropy[i], rejected[i] = model.langs[b], float(s), float(e), bool(e > model.reject)
                at, rows, size = [], [], 0

            for i, text in enumerate(texts):
                if text and model.langs and has_letter(_codes(text)):
                    at.append(i)
                    rows.append(model.symbols(text))
                    size += len(rows[-1])
                    if size >= _CHUNK:
                        settle()
            settle()
            cols = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "nearest", "score", "entropy", "rejected"])

    return work


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The language of least cross-entropy a symbol for each whole text.

    Returns doc_id, lang (``und`` where the entropy is above what held-back
    training texts show), nearest (without that rejection), score, entropy,
    rejected, a row for each input row. Null, empty and letterless texts:
    ``und``, score 0. Null doc_id stays null. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.transform(arrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, nearest string, score double, entropy double, rejected boolean"))
    return out.select("doc_id", F.when(F.col("rejected"), "und").otherwise(F.col("nearest")).alias("lang"), "nearest", "score", "entropy", "rejected")
