"""Packing token sequences: Martello-Toth dominance reduction, then best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stash
from .tokens import encoder
from .worker import arrow

#: Documents of one length that are numbered in one task.
STRIPE = 100_000


def _cut(name: str, size: int, end: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                first = len(ids) % size or size
                at = 0
                for p in range(-(-len(ids) // size)):
                    stop = first + p * size
                    doc.append(d)
                    piece.append(p)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[at:stop].tobytes()))
                    at = stop
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return work


def reduce_and_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] items of each length, as (number of bins, [(length, items of it in each bin)]).

    What the reduction fixes is no loss: some best packing has those bins.
    What it leaves goes to best fit, largest first.
    """
    bins, left = reduce(counts, size)
    return bins + _best_fit([(x, left[x]) for x in sorted(left, reverse=True)], size)


def reduce(counts: dict[int, int], size: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Martello-Toth reduction: bins that some best packing has, and the items that are left.

    For an item x, largest first, the partners are all items not yet fixed,
    larger and smaller. A set beside x dominates another if the items of the
    other can be dealt out to its items, each to one at least as long as their
    sum; if one set dominates all that fit beside x, that bin is fixed, for as
    many copies of x as it stays so. That is known in these cases, y being the
    largest item that fits: nothing fits; y fills the bin; no two others fit
    together; or no three do and the largest pair that does is no longer than
    y. If y is shorter than that pair, the pair dominates when its longer item
    is y and no other pair's shorter item is longer than its own.
    Items that are fixed may settle items before them, so it goes on until
    nothing changes.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    changed = True
    while changed:
        changed = False
        for x in map(int, np.flatnonzero(left)[::-1]):
            while left[x] and (held := _dominating(left, x, size)) is not None:
                # Fixing a bin takes items away, which can only make its rivals fewer; it holds while its own items last.
                n = min(int(left[length]) // per for length, per in held)
                bins.append((n, held))
                for length, per in held:
                    left[length] -= n * per
                changed = True
    return bins, {int(x): int(left[x]) for x in np.flatnonzero(left)}


def _dominating(left: np.ndarray, x: int, size: int) -> list[tuple[int, int]] | None:
    """The bin with one x that dominates all others with it, as (length, items), longest first; None if none is known to."""
    gap = size - x
    have = left[: gap + 1].copy()
    if x <= gap:
        have[x] -= 1
    lengths = np.flatnonzero(have)
    if not len(lengths):
        return [(x, 1)]
    y = int(lengths[-1])
    best = [x, y]
    if y != gap:
        few = np.repeat(lengths[:3], np.minimum(have[lengths[:3]], 3))[:3]  # the three shortest partners
        if len(few) > 1 and few[:2].sum() <= gap:
            if len(few) > 2 and few.sum() <= gap:
                return None
            p, q = _best_pair(have, lengths, gap)
            if p + q > y:
                if p != y or not _covers(have, lengths, q, gap):
                    return None
                best = [x, p, q]
    return [(length, best.count(length)) for length in dict.fromkeys(best)]


def _best_pair(have: np.ndarray, lengths: np.ndarray, gap: int) -> tuple[int, int]:
    """The two partners of the largest sum up to the gap, longer first; of equal sums the one with the longest item. There is one."""
    at = np.searchsorted(lengths, np.minimum(gap - lengths, lengths), "right") - 1
    at -= (at >= 0) & (lengths[at] == lengths) & (have[lengths] < 2)
    ok = at >= 0
    long, short = lengths[ok], lengths[at[ok]]
    total = long + short
    i = np.flatnonzero(total == total.max())[-1]
    return int(long[i]), int(short[i])


def _covers(have: np.ndarray, lengths: np.ndarray, q: int, gap: int) -> bool:
    """Whether the shorter item of every pair of partners is at most q."""
    short = lengths[(lengths > q) & (lengths <= gap // 2)]
    long = lengths[np.searchsorted(lengths, gap - short, "right") - 1]
    return not ((long > short) | (have[short] > 1)).any()


def _best_fit(items: list[tuple[int, int]], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, largest first, on bins grouped by the space they have left."""
    room: list[list[list]] = [[] for _ in range(size + 1)]  # by space left: [bins, contents]
    have = np.zeros(size + 1, np.int64)
    for length, n in items:
        while n:
            fits = np.flatnonzero(have[length:])
            if not len(fits):
                each = size // length
                for per, count in ((each, n // each), (n % each, 1)):
                    if per and count:
                        room[size - per * length].append([count, [(length, per)]])
                        have[size - per * length] += count
                n = 0
                continue
            space = length + int(fits[0])
            count, held = room[space].pop()
            have[space] -= count
            # A bin takes the item as often as it can: it stays the fullest that fits.
            per = space // length
            taken = 0
            for each, some in ((per, min(count, n // per)), (n % per, 1)):
                if each and some and taken < count and n:
                    room[space - each * length].append([some, [*held, (length, each)]])
                    have[space - each * length] += some
                    taken += some
                    n -= some * each
            if taken < count:
                room[space].append([count - taken, held])
                have[space] += count - taken
    return [(count, held) for groups in room for count, held in groups]


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Of each length: rows (first rank, first sequence, offset in it, items a sequence), by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for count, held in bins:
        offset = 0
        for length, per in held:
            at = used.get(length, 0)
            rows.setdefault(length, []).append((at, sequence, offset, per))
            used[length] = at + count * per
            offset += length * per
        sequence += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                at = length == size
                rows = places[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                n, k = np.divmod(rank[at] - row[:, 0], row[:, 3])
                seq[at], off[at] = row[:, 1] + n, row[:, 2] + k * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return work


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """Pack tokenised documents into as few sequences of at most ``size`` tokens as the method finds.

    Documents longer than a sequence are cut from the end, so that only the
    first piece is shorter. What is solved on the driver is the number of
    pieces of each length, at most ``size`` numbers whatever the input. Pieces
    then take their places by rank among those of their length; ranks are
    counted in stripes and joined up, so no length has to fit in one task.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null text: empty, one piece of the end token. Null doc_id and repeated
    rows are documents of their own. Empty table: no rows. Other columns are
    not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(docs.transform(arrow(_cut(tokenizer, size, end), "doc_id long, piece int, start long, length long, ids_crc32 long")), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    shared = spark.sparkContext.broadcast(_places(reduce_and_fit(counts, size)))
    stripes = 1 + sum(counts.values()) // STRIPE
    pieces = pieces.withColumn("stripe", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(stripes)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.groupBy("length", "stripe").agg(F.count(F.lit(1)).alias("n")).select("length", "stripe", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "stripe").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(starts, ["length", "stripe"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").transform(arrow(_place(shared), schema))
