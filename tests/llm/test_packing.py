"""Reduction and best fit against an exact solver, and invariants of whole packings."""

import random

from inkveil.llm import packing
from inkveil.llm.packing import reduce, reduce_and_fit
from inkveil.llm.queries import VOCABULARY


def n_bins(bins):
    return sum(n for n, _ in bins)


def fitted(items, size):
    counts = {x: items.count(x) for x in sorted(set(items), reverse=True)}
    return n_bins(packing._best_fit(list(counts.items()), size))


def optimum(items, size):
    """Fewest bins, by trying all places of each item that differ."""
    items = sorted(items, reverse=True)
    best = fitted(items, size)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= size}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        if len(bins) + 1 < best:
            go(i + 1, [*bins, items[i]])

    if best > -(-sum(items) // size):
        go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    fixed = whole = 0
    for _ in range(1500):
        size = rng.choice([10, 20, 50, 100, 200])
        items = [rng.randint(1, size) if rng.random() < 0.6 else rng.randint(max(1, size // 6), size // 2) for _ in range(rng.randint(1, 11))]
        bins, left = reduce({x: items.count(x) for x in items}, size)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert n_bins(bins) + optimum(rest, size) == optimum(items, size), (items, size)
        held = [x for n, held in bins for x, per in held for _ in range(n * per)]
        assert sorted(held + rest) == sorted(items)
        fixed, whole = fixed + len(held), whole + len(items)
    assert fixed > whole / 2


def test_never_worse_than_best_fit():
    rng = random.Random(4)
    better = 0
    for _ in range(3000):
        size = rng.choice([50, 300, 2048])
        counts = {rng.randint(1, size): rng.randint(1, 60) for _ in range(rng.randint(1, 60))}
        mine, plain = n_bins(reduce_and_fit(counts, size)), n_bins(packing._best_fit(sorted(counts.items(), reverse=True), size))
        assert mine <= plain
        better += mine < plain
    assert better
    assert n_bins(reduce_and_fit({60: 1, 25: 1, 18: 1, 17: 1}, 100)) == 2


def test_query_places_every_piece_without_gaps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "a"), (None, "b"), (None, None), (1, "a")], "doc_id long, text string"))
    rows = packing.pack(some, VOCABULARY).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and 0 < length <= 2048
            at += length
        assert at <= 2048
    counts = {}
    for r in rows:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(by) == n_bins(reduce_and_fit(counts, 2048))
    assert len({(r.doc_id, r.piece) for r in rows if r.doc_id is not None}) + 3 + 1 == len(rows)
