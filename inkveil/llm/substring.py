"""Removal of word passages that occur earlier in the corpus (count-min prefilter)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingle import documents, mix, signed
from .store import slots
from .worker import arrow

#: Rows of the count-min sketch.
DEPTH = 2
#: Windows, and windows estimated repeated, that a task holds before it sends what it has.
FLUSH, FLUSH_REPEATED = 1 << 22, 1 << 20
_SALTS = (0x1B873593, 0x5BD1E995)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h, _SALTS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted distinct cells as byte-sized gaps; 255 carries on."""
    gaps = np.diff(cells.astype(np.int64), prepend=-1)
    more, rest = np.divmod(gaps, 255)
    at = np.cumsum(more + 1) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, 255, np.uint8)
    out[at] = rest
    return out.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255] - 1


def _shard_bits(bits: int) -> int:
    return min(bits, 20)


def _sketch(window: int, bits: int):
    """Per task: for each sketch row and shard, the cells seen once and those seen at least twice."""
    low = _shard_bits(bits)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        shard, once, twice = [], [], []
        h = np.concatenate(held)
        for row in range(DEPTH):
            cells = np.sort(_cells(h, row, bits))
            first = np.r_[True, cells[1:] != cells[:-1]]
            at = np.flatnonzero(first)
            again = np.diff(np.r_[at, len(cells)]) > 1
            cells = cells[at]
            high = cells >> np.uint32(low)
            cuts = np.r_[0, np.flatnonzero(np.diff(high)) + 1, len(cells)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = cells[i:j] & np.uint32((1 << low) - 1)
                shard.append((row << (bits - low)) + int(high[i]))
                once.append(_pack(part))
                twice.append(_pack(part[again[i:j]]))
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["shard", "once", "twice"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, words in documents(batch.column("text")):
                h, _, _ = words.shingles(window, words.hashes())
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    return work


def _merge(bits: int):
    """Add up the sketches of all tasks, shard by shard as they stream in; keeps a bit for each cell counted twice or more."""
    size = 1 << _shard_bits(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])

        for batch in batches:
            for shard, once, twice in zip(*(batch.column(c).to_pylist() for c in ("shard", "once", "twice")), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, count = shard, np.zeros(size, np.uint8)
                for blob in (once, twice):
                    cells = _unpack(blob)
                    count[cells] = np.minimum(count[cells] + 1, 2)
        if now is not None:
            yield done()

    return work


def sketch(docs: DataFrame, window: int, bits: int) -> list[np.ndarray]:
    """The merged count-min sketch, reduced to one bit a cell: DEPTH * 2**bits / 8 bytes, whatever the input."""
    low = _shard_bits(bits)
    parts = docs.select("text").transform(arrow(_sketch(window, bits), "shard int, once binary, twice binary"))
    merged = parts.repartition(slots(docs.sparkSession), "shard").sortWithinPartitions("shard").transform(arrow(_merge(bits), "shard int, bits binary"))
    out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(DEPTH)]
    for row in merged.toLocalIterator(prefetchPartitions=True):
        r, s = divmod(row.shard, 1 << (bits - low))
        part = np.frombuffer(row.bits, np.uint8)
        out[r][s * len(part) : (s + 1) * len(part)] = part
    return out


def _candidates(window: int, bits: int, shared):
    """Windows that the sketch counts at least twice. Of those alike in one task only the first is sent; the rest are known repeats and go as spans."""

    def maybe(h: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
        at = np.arange(len(h))
        for row in range(DEPTH):
            cells = _cells(h[at], row, bits)
            at = at[(table[row][cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 == 1]
        return at

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((start, doc, h2, h1))
        h1, h2, doc, start = h1[by], h2[by], doc[by], start[by]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        repeat = (doc != doc[head]) | (start != start[head])
        d, s = doc[repeat], start[repeat]
        by = np.lexsort((s, d))
        d, s = d[by], s[by]
        cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + window)]) if len(d) else np.zeros(0, int)
        ends = s[np.r_[cut[1:], len(s)] - 1] + window if len(d) else s
        keep = np.flatnonzero(~repeat)
        keep = keep[np.lexsort((start[keep], doc[keep]))]  # neighbours in a document compress well
        cols = (
            signed(np.r_[h1[keep], mix(d[cut].astype(np.uint64) ^ (s[cut].astype(np.uint64) << np.uint64(40)))]),
            np.r_[h2[keep], np.zeros(len(cut), np.int32)],
            np.r_[doc[keep], d[cut]],
            np.r_[start[keep], s[cut]].astype(np.int32),
            np.r_[np.zeros(len(keep), np.int32), ends.astype(np.int32)],
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h1", "h2", "doc_id", "start", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.frombuffer(zlib.decompress(x), np.uint8) for x in shared.value]
        held, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, words in documents(batch.column("text")):
                h, doc, start = words.shingles(window, words.hashes())
                at = maybe(h, table)
                if not len(at):
                    continue
                other = words.shingles(window, words.hashes(1))[0][at]
                held.append((h[at], (other >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[i + doc[at]], start[at]))
                n += len(at)
                if n >= FLUSH_REPEATED:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    return work


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, total, removed, digest, kept = batch.column("doc_id"), [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or "").encode().split()
            if spans:
                step = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    step[min(s["start"], len(words))] += 1
                    step[min(s["end"], len(words))] -= 1
                out = list(compress(words, np.cumsum(step)[:-1] == 0))
            else:
                out = words
            line = b" ".join(out)
            total.append(len(words))
            removed.append(len(words) - len(out))
            digest.append(hashlib.sha256(line).hexdigest())
            kept.append(line.decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def sketch_bits(docs: DataFrame, most: int = 29) -> int:
    """Cells for about eight times the windows that the files' size suggests. It only decides how many windows go to the exact pass."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(most, max(16, (size * 3).bit_length())))


def dedup_substrings(docs: DataFrame, window: int = 20, bits: int | None = None) -> DataFrame:
    """Remove each word covered by a window of words that also starts earlier in the corpus.

    Earlier: in a document of smaller doc_id, or further up in the same one.
    First pass: each task counts its windows in sparse count-min rows, which
    are merged by shard. An estimate is never too small, so a window estimated
    once is unique. Second pass: only windows estimated at twice or more are
    grouped, by 96 bits of keyed hashes of their words. The broadcast sketch has at most
    2 * 2**29 bits (128 MB); where the corpus outgrows it more windows go to
    the exact pass, and the result is the same.

    Returns doc_id, n_words, n_removed, kept_sha256, kept_text, a row for each
    input row. Null text: no words. Null doc_id: no place in the order, so
    nothing is removed from it and it is no one's original. Rows that share a
    doc_id share their starts: neither copy counts as earlier, and what is
    removed in one is removed at the same place of the other. Other columns
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())
    bits = bits or sketch_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast([zlib.compress(x, 1) for x in sketch(named, window, bits)])
    rows = named.transform(arrow(_candidates(window, bits, shared), "h1 long, h2 int, doc_id long, start int, end int"))
    rank = F.rank().over(Window.partitionBy("h1", "h2", "end").orderBy("doc_id", "start"))
    spans = (
        rows.withColumn("rank", rank)
        .where((F.col("end") > 0) | (F.col("rank") > 1))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", F.when(F.col("end") > 0, F.col("end")).otherwise(F.col("start") + window).alias("end"))).alias("spans"))
    )
    return docs.join(spans, "doc_id", "left").transform(arrow(_rewrite, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))
